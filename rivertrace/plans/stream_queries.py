"""Streaming jobs run to the end of the given tables; each returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.operators.detectors import anomaly_record
from rivertrace.plans.common import us
from rivertrace.plans.detection_queries import _SERIES, _record, _scales
from rivertrace.plans.oracle_entities import with_entities
from rivertrace.session import configure, scratch_path
from rivertrace.sources import tables as T
from rivertrace.sources.stores import is_folder
from rivertrace.streaming import jobs as J

WARMUP = 20
ONCE = {"availableNow": True}


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(T.table(spark, folder, name).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class _Streamed:
    """Stands in for a River whose tables are streams, so the entity rules are reused as they are."""

    def __init__(self, spark: SparkSession):
        self.read = self
        self.spark = spark

    def parquet(self, path: str) -> DataFrame:
        folder, _, file = path.rpartition("/")
        return table_stream(self.spark, folder, file.removesuffix(".parquet"))


def _paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    root = scratch_path(spark, name)
    return f"{root}/state", f"{root}/out", f"{root}/progress"


def stream_cusum(spark, folder):
    configure(spark)
    state, out, progress = _paths(spark, "cusum")
    J.stream_cusum(T.readings(_Streamed(spark), folder), state, out, progress, warmup_rows=WARMUP, trigger=ONCE).awaitTermination()
    found = anomaly_record(spark.read.parquet(out))
    return found.select("station_id", "indicator", "idx", us().alias("ts_us"), "value", "baseline", "zscore", "severity")


def stream_log(spark, folder):
    """Only new messages reach the log, each once."""
    configure(spark)
    _, out, progress = _paths(spark, "messages")
    J.record_messages(T.messages(_Streamed(spark), folder), out, progress, trigger=ONCE).awaitTermination()
    fields = "inv_id string, seq bigint, type string, item_id string, score double, text string"
    return spark.read.schema(fields).json(out).select("inv_id", "seq", "type", "item_id", "text")


def stream_first(spark, folder):
    """Keep-first per investigation and item; which replay arrives first is not fixed, so keys are returned."""
    configure(spark)
    _, out, progress = _paths(spark, "first")
    stamped = T.messages(_Streamed(spark), folder).withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq")))
    writer = J.first_messages(stamped).select("inv_id", "item_id").writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", progress).trigger(**ONCE).start().awaitTermination()
    return spark.read.schema("inv_id string, item_id string").parquet(out)


def stream_steps(spark, folder):
    """The log with each step once, as it was first told."""
    configure(spark)
    _, out, progress = _paths(spark, "steps")
    query, current = J.first_steps(T.messages(_Streamed(spark), folder), out, progress, trigger=ONCE)
    query.awaitTermination()
    return current().select("inv_id", "seq", "type", "item_id", "text")


def stream_latest(spark, folder):
    configure(spark)
    state, _, progress = _paths(spark, "latest")
    stream = T.messages(_Streamed(spark), folder).where("type = 'hypothesis'")
    query, current = J.latest_hypotheses(stream, state, progress, trigger=ONCE)
    query.awaitTermination()
    return current().select("inv_id", "item_id", "seq", "text")


def stream_suppression(spark, folder):
    configure(spark)
    state, out, progress = _paths(spark, "suppression")
    alerts = T.alerts(_Streamed(spark), folder).select("id", "station_id", F.col("onset_ts").alias("ts"), "severity")
    J.suppress_alerts(alerts, state, out, progress, trigger=ONCE).awaitTermination()
    return spark.read.parquet(out).select("id", "station_id", us().alias("ts_us"), "severity")


def stream_guard(spark, folder):
    """Message guard over the raw log as a stream."""
    configure(spark)
    _, out, progress = _paths(spark, "guard")
    raw = T.messages(_Streamed(spark), folder).withColumn("raw", F.to_json(F.struct("type", F.struct("item_id").alias("data"))))
    writer = J.guarded(raw).select("inv_id", "seq", "type").writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", progress).trigger(**ONCE).start().awaitTermination()
    return spark.read.schema("inv_id string, seq bigint, type string").parquet(out)


QUERIES = {
    "stream_cusum": (stream_cusum, with_entities(
        _record("cusum", "s>7 AND last<=7"), "positioned", extra=(
            *_scales("positioned", f"idx < {WARMUP}"),
            ("walk", "SELECT p.*, mu AS base, sum((value-mu)/sd-0.5) OVER w AS cu, sum(-(value-mu)/sd-0.5) OVER w AS cd"
             " FROM positioned p JOIN scales s ON s.station_id=p.station_id AND s.indicator=p.indicator"
             f" WHERE n >= {WARMUP} WINDOW w AS (PARTITION BY p.station_id, p.indicator ORDER BY idx)"),
            ("stat", "SELECT *, greatest(cu-least(0,min(cu) OVER w), cd-least(0,min(cd) OVER w)) AS s FROM walk"
             f" WINDOW w AS ({_SERIES} ORDER BY idx)"),
            ("cusum", f"SELECT *, s/7 AS z, lag(s,1,0) OVER ({_SERIES} ORDER BY idx) AS last FROM stat"),
        ))),
    "stream_log": (stream_log, with_entities("SELECT inv_id, seq, type, item_id, text FROM messages", "messages")),
    "stream_first": (stream_first, with_entities("SELECT DISTINCT inv_id, item_id FROM messages", "messages")),
    "stream_steps": (stream_steps, with_entities(
        "SELECT inv_id, seq, type, item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY inv_id, item_id, type ORDER BY seq NULLS FIRST,"
        " score NULLS FIRST, text NULLS FIRST) AS rn FROM messages) WHERE rn=1 OR type<>'step'", "messages")),
    "stream_latest": (stream_latest, with_entities(
        "SELECT inv_id, item_id, max(seq) AS seq, arg_max(text, seq) AS text FROM messages WHERE type='hypothesis' GROUP BY 1,2", "messages")),
    "stream_guard": (stream_guard, with_entities("SELECT inv_id, seq, type FROM messages WHERE type<>'connected'", "messages")),
    "stream_suppression": (stream_suppression, with_entities(
        "SELECT q.id, q.station_id, epoch_us(q.onset_ts) AS ts_us, severity FROM alerts q JOIN (SELECT station_id, ts, min(id) AS id"
        " FROM alerts JOIN passed USING (station_id) WHERE onset_ts=ts GROUP BY ALL) k ON k.id=q.id", "alerts", extra=(
            ("passed", "SELECT station_id, min(onset_ts) AS ts FROM alerts GROUP BY 1 UNION ALL SELECT p.station_id,"
             " (SELECT min(onset_ts) FROM alerts a WHERE a.station_id=p.station_id AND a.onset_ts >= p.ts + INTERVAL 48 HOUR) FROM passed p"
             " WHERE p.ts IS NOT NULL"),
        ))),
}
