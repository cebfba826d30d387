"""Structured Streaming forms of detection, log handling and alert suppression.

State that outlives a micro-batch and must stay exact under a busy key is kept as a versioned table: a
batch reads the version before it and writes its own, so a batch run again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivertrace.operators.alerts import suppression_chain
from rivertrace.operators.blocks import DAY, SERIES, attach_positions, not_null, time_block
from rivertrace.operators.casefile import guard_messages
from rivertrace.operators.detectors import cusum_crossings, cusum_scan
from rivertrace.operators.quantiles import robust_scale
from rivertrace.session import cut_lineage
from rivertrace.sources.stores import path_exists

REFRESH = "30 seconds"  # fixed value: refresh cadence of alert lists
LATENESS = "2 hours"


class VersionedTable:
    """A small table with one Parquet folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch_id: int) -> DataFrame:
        folder = f"{self.path}/v={batch_id - 1}"
        if batch_id > 0 and path_exists(self.spark, folder):
            return self.spark.read.schema(self.schema).parquet(folder)
        return self.spark.createDataFrame([], self.schema)

    def write(self, batch_id: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={batch_id}")


CUSUM_STATE = (
    "station_id STRING, indicator STRING, seen BIGINT, last_ts TIMESTAMP, median DOUBLE, sigma DOUBLE, "
    "up_start DOUBLE, down_start DOUBLE"
)
WARMUP_ROWS = "station_id STRING, indicator STRING, ts TIMESTAMP, value DOUBLE"


def cusum_batch(
    spark: SparkSession, state_path: str, out_path: str, warmup_rows: int, k: float, h: float, block_seconds: int,
    late_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """One micro-batch of the CUSUM detector.

    A series waits until it has ``warmup_rows`` readings; they fix its median and sigma and are then
    judged with the rest. Afterwards only S+, S-, the count and the last time are kept. Inside a batch
    the blocked scan of the batch detector runs, so one busy series is spread over tasks. Readings at one time
    are all judged, in order of value. Readings not newer than the last one judged are late: they go to ``late_path``,
    a folder per micro-batch, for the batch detector.
    """
    states = VersionedTable(spark, f"{state_path}/series", CUSUM_STATE)
    waiting = VersionedTable(spark, f"{state_path}/warmup", WARMUP_ROWS)
    keys = list(SERIES)

    def run(batch: DataFrame, batch_id: int) -> None:
        state, held = states.before(batch_id), waiting.before(batch_id)
        arrived = batch.select(*keys, "ts", "value").where(not_null(*keys, "ts", "value"))
        newest = state.select(*keys, "last_ts")
        placed = cut_lineage(arrived.join(newest, keys, "left"))
        is_late = F.col("last_ts").isNotNull() & (F.col("ts") <= F.col("last_ts"))
        late = placed.where(is_late)
        late.write.mode("overwrite").parquet(f"{late_path or state_path + '/late'}/batch={batch_id}")
        rows = placed.where(~is_late).drop("last_ts").unionByName(held)
        # The rows of the batch are used several times below; they are written once.
        blocked = cut_lineage(rows.withColumn("block", time_block("ts", block_seconds)))
        sizes = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        ready = sizes.join(state.select(*keys, F.lit(True).alias("started")), keys, "left").where(
            F.col("started") | (F.col("rows") >= warmup_rows)
        )
        # Blocks are bounded, so the facts of a series travel on (series, block).
        blocks = cut_lineage(
            blocked.select(*keys, "block").distinct().join(ready.select(*keys), keys, "left_semi")
        )
        unready = blocked.join(blocks, [*keys, "block"], "left_anti").select(*keys, "ts", "value")
        waiting.write(batch_id, unready)
        usable = blocked.join(blocks, [*keys, "block"], "left_semi")
        starting = usable.join(
            blocks.join(state.select(*keys), keys, "left_anti"), [*keys, "block"], "left_semi"
        )
        scales = robust_scale(attach_positions(starting).where(F.col("idx") < warmup_rows), keys)
        facts = cut_lineage(
            state.select(*keys, "seen", "median", "sigma", "up_start", "down_start").unionByName(
                scales.select(
                    *keys, F.lit(0).cast("bigint").alias("seen"), "median", "sigma",
                    F.lit(0.0).alias("up_start"), F.lit(0.0).alias("down_start"),
                )
            )
        )
        starts = facts.select(*keys, "up_start", "down_start")
        scanned = cusum_scan(attach_positions(usable, facts=facts.drop("up_start", "down_start")), k, h, starts)
        path = cut_lineage(scanned.withColumn("idx", F.col("idx") + F.col("seen")))
        cusum_crossings(path, h).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        last = path.groupBy(*keys).agg(
            F.max(F.struct("idx", "ts", "median", "sigma", "up", "down")).alias("e")
        ).select(
            *keys, (F.col("e.idx") + 1).alias("seen"), F.col("e.ts").alias("last_ts"), "e.median", "e.sigma",
            F.col("e.up").alias("up_start"), F.col("e.down").alias("down_start"),
        )
        kept = state.join(last.select(*keys), keys, "left_anti")
        states.write(batch_id, last.unionByName(kept))

    return run


def stream_cusum(
    readings: DataFrame, state_path: str, out_path: str, checkpoint: str, warmup_rows: int = 200, k: float = 0.5,
    h: float = 7.0, block_seconds: int = DAY, trigger: dict | None = None, late_path: str | None = None,
) -> StreamingQuery:
    """Continuous detection; anomalies go to ``out_path``, late readings to ``late_path`` (by default below
    ``state_path``), in one folder per micro-batch."""
    step = cusum_batch(readings.sparkSession, state_path, out_path, warmup_rows, k, h, block_seconds, late_path)
    return _start(readings.writeStream.foreachBatch(step), checkpoint, trigger)


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": REFRESH})).start()


def record_messages(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends only new messages to the log, each once: JSON lines below a folder per investigation."""
    writer = messages.writeStream.format("json").partitionBy("inv_id").option("path", path).outputMode("append")
    return _start(writer, checkpoint, trigger)


def guarded(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Message guard on a stream of raw text."""
    return guard_messages(raw, column)


def first_messages(messages: DataFrame, item: str = "item_id", lateness: str = LATENESS) -> DataFrame:
    """Keep-first per (investigation, item) across replays within the watermark on ``at``."""
    return messages.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["inv_id", item])


def _item_table(
    messages: DataFrame, out_path: str, checkpoint: str, item: str, latest: bool, alone: Column, trigger: dict | None
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Messages of which ``alone`` holds, reduced to one per (investigation, item) in the engine's own state; others as they are.

    Each micro-batch writes the items that it changed, and the other messages, to a folder of its own; a batch that runs
    again writes the same. The reader folds the folders by the same rule, so the table needs nothing but the files.
    """
    fields = messages.columns
    rest = [c for c in fields if c not in ("seq", "inv_id", item)]
    row = F.struct("seq", *rest)
    pick = F.max(row) if latest else F.min(row)

    def reduced(df: DataFrame) -> DataFrame:
        found = df.where(alone).groupBy("inv_id", item).agg(pick.alias("_row"))
        return found.select(*[F.col(c) if c in ("inv_id", item) else F.col("_row")[c].alias(c) for c in fields])

    apart = ~F.coalesce(alone, F.lit(False))
    stream = reduced(messages).unionByName(messages.where(apart))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    def current() -> DataFrame:
        spark = messages.sparkSession
        if not path_exists(spark, out_path):
            return spark.createDataFrame([], messages.schema)
        table = spark.read.schema(messages.schema).parquet(out_path).select(*fields)
        return reduced(table).unionByName(table.where(apart))

    return _start(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger), current


def first_steps(
    messages: DataFrame, out_path: str, checkpoint: str, item: str = "item_id", trigger: dict | None = None
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """The log with each step of an investigation once, as it was first told (smallest ``seq``; of repeats the smallest row).

    Only steps are told apart by item; every other message is kept, replays of it too. However late a replay comes,
    its step is known, as the state holds one row per step and has no time limit. Returns the query and a function
    that reads the current table, also after a restart.
    """
    return _item_table(messages, out_path, checkpoint, item, False, F.col("type") == "step", trigger)


def latest_hypotheses(
    messages: DataFrame, out_path: str, checkpoint: str, item: str = "item_id", trigger: dict | None = None
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Latest message per (investigation, item) by ``seq``; of repeats the greatest row.

    Returns the query and a function that reads the current table, also after a restart without new messages.
    """
    return _item_table(messages, out_path, checkpoint, item, True, F.lit(True), trigger)


SUPPRESSION_STATE = "station_id STRING, until TIMESTAMP"


def suppression_batch(
    spark: SparkSession, state_path: str, out_path: str, hours: int
) -> Callable[[DataFrame, int], None]:
    """Drops alerts of a station that has had one in the ``hours`` before, in order of time.

    Which alerts of a batch are raised is found by ``suppression_chain``; between batches only the end of each
    station's silence is kept.
    """
    states = VersionedTable(spark, state_path, SUPPRESSION_STATE)
    span = hours * 3_600_000_000

    def run(batch: DataFrame, batch_id: int) -> None:
        silenced = states.before(batch_id)
        passed = cut_lineage(suppression_chain(batch, hours, silenced))
        passed.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        end = F.timestamp_micros(F.unix_micros(F.max("ts")) + F.lit(span) - 1)
        until = passed.where(not_null("station_id", "ts")).groupBy("station_id").agg(end.alias("until"))
        states.write(batch_id, until.unionByName(silenced.join(until.select("station_id"), "station_id", "left_anti")))

    return run


def suppress_alerts(
    alerts: DataFrame, state_path: str, out_path: str, checkpoint: str, hours: int = 48, trigger: dict | None = None
) -> StreamingQuery:
    """Alert suppression on a stream of (id, station_id, ts, ...)."""
    step = suppression_batch(alerts.sparkSession, state_path, out_path, hours)
    return _start(alerts.writeStream.foreachBatch(step), checkpoint, trigger)
