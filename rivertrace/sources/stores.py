"""Readings, alerts, investigation logs and reports on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace import schemas
from rivertrace.session import write_once


def _by_date(readings: DataFrame) -> DataFrame:
    """Rows in ranges of (date, series, time): few files per date, and neither a busy date nor a busy
    series ends up in one task. Sorted rows let row-group statistics prune."""
    order = ("date", "station_id", "indicator", "ts")
    dated = readings.withColumn("date", F.to_date("ts"))
    return dated.repartitionByRange(*order).sortWithinPartitions(*order)


def write_readings(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by date."""
    _by_date(readings).write.mode(mode).partitionBy("date").parquet(path)


def replace_dates(readings: DataFrame, path: str) -> None:
    """Overwrites only the dates present in ``readings``."""
    writer = _by_date(readings).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.READINGS}, date DATE").parquet(path)


def stored_on(spark: SparkSession, path: str, dates: list) -> DataFrame:
    """Stored readings of the given dates; other folders are neither listed in the scan nor read."""
    return read_readings(spark, path).where(F.col("date").isin(dates))


def merge_readings(new: DataFrame, path: str) -> int:
    """Insert-or-replace on (station_id, indicator, ts) in the store at ``path``; returns the number of dates rewritten.

    ``new`` has the columns of a reading and ``version``: it beats what is stored, and among rows of one key the highest
    version wins, ties by value. Rows without station, indicator or time have no key and are left out. Only dates that ``new``
    touches are read and rewritten; their list, one entry a day, is all that reaches the driver. The merged rows are
    written to the shared folder first, so that the store is never read while it is replaced. An empty ``new`` changes nothing.
    """
    spark, key = new.sparkSession, ["station_id", "indicator", "ts"]
    keyed = new.where(F.col("station_id").isNotNull() & F.col("indicator").isNotNull() & F.col("ts").isNotNull())
    coming = write_once(keyed.select(*key, "value", F.col("version").cast("bigint").alias("version")), "coming")
    dates = [row["date"] for row in coming.select(F.to_date("ts").alias("date")).distinct().collect()]
    if not dates:
        return 0
    rows = coming.select(*key, F.struct(F.lit(1).alias("fresh"), "version", "value").alias("r"))
    if path_exists(spark, path):
        none = F.lit(None).cast("bigint").alias("version")
        rows = rows.unionByName(stored_on(spark, path, dates).select(*key, F.struct(F.lit(0).alias("fresh"), none, "value").alias("r")))
    merged = rows.groupBy(*key).agg(F.max("r")["value"].alias("value")).select("station_id", "ts", "indicator", "value")
    replace_dates(write_once(merged, "merged"), path)
    return len(dates)


def reload_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Truncate and load: each table replaces what is stored under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def append_messages(messages: DataFrame, path: str) -> None:
    """One JSON line per message below a folder per investigation."""
    messages.write.mode("append").partitionBy("inv_id").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages as written, blank lines skipped; empty when nothing was recorded. Order by ``seq``."""
    fields = "seq BIGINT, type STRING, data STRING, at TIMESTAMP"
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"inv_id STRING, {fields}")
    lines = spark.read.schema("value STRING, inv_id STRING").text(path)  # else "007" would be read as 7
    return (
        lines.where(F.trim("value") != "")
        .select("inv_id", F.from_json("value", fields).alias("m"))
        .select("inv_id", "m.*")
    )


def replay(spark: SparkSession, path: str, inv_id: str) -> DataFrame:
    """One investigation in order; only its folder is read."""
    return read_messages(spark, path).where(F.col("inv_id") == inv_id).orderBy("seq")


def recordings(messages: DataFrame) -> DataFrame:
    return messages.select("inv_id").distinct().orderBy("inv_id")


def save_reports(lines: DataFrame, path: str) -> None:
    """Report text below a folder per investigation, lines in order.

    Takes casefile.report_lines. Lines are range-partitioned by investigation and order, so a long
    report may span files; their names sort in order.
    """
    order = ["inv_id", "section", "lead", "item", "part", "line"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("inv_id", F.col("line").alias("value"))
        .write.mode("overwrite").partitionBy("inv_id").text(path)
    )


def report_path(spark: SparkSession, path: str, inv_id: str) -> str | None:
    """Folder of an investigation's report, None if it has none."""
    folder = f"{path}/inv_id={inv_id}"
    return folder if path_exists(spark, folder) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def status_log(changes: DataFrame, path: str) -> None:
    """Status changes (id, status, at) are appended, never updated in place."""
    changes.write.mode("append").parquet(path)


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per id; a later time wins, then the later status name."""
    return log.groupBy("id").agg(
        F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at")
    )


# Event status that follows each investigation outcome.
STATUS_AFTER = {"running": "investigating", "resolved": "resolved", "failed": "open"}


def event_status_after(investigations: DataFrame) -> DataFrame:
    """Status change of the event behind each investigation row (event_id, status, at)."""
    after = F.create_map(*[F.lit(x) for pair in STATUS_AFTER.items() for x in pair])
    return investigations.select(F.col("event_id").alias("id"), after[F.col("status")].alias("status"), "at")
