"""The monitor scan: recent anomalies to alert events, with suppression of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace.operators.blocks import DAY, SERIES, asof_facts, not_null, running, time_block, with_blocks
from rivertrace.operators.detectors import detect
from rivertrace.session import cut_lineage

MIN_SAMPLES = 48  # fixed value: fewer recent readings than this are not judged
SUPPRESS_H = 48  # fixed value: an open alert this recent suppresses another


def latest_time(readings: DataFrame) -> Column:
    """The newest reading time as a scalar subquery."""
    return readings.agg(F.max("ts").alias("at")).scalar()


def recent_readings(readings: DataFrame, window_h: int, now: Column | None = None) -> DataFrame:
    """Readings of the last ``window_h`` hours, counted back from the data's own latest time."""
    now = latest_time(readings) if now is None else now
    return readings.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(window_h)))


def enough_samples(readings: DataFrame, minimum: int = MIN_SAMPLES) -> DataFrame:
    """Keeps series with at least ``minimum`` readings.

    Counts are pre-aggregated per (series, block) and reach the rows through the block, so a busy
    series is not gathered.
    """
    blocked = with_blocks(readings)
    sizes = blocked.groupBy(*SERIES, "block").agg(F.count(F.lit(1)).alias("_rows"))
    kept = sizes.withColumn("_n", F.sum("_rows").over(Window.partitionBy(*SERIES))).where(F.col("_n") >= minimum)
    return blocked.join(kept.drop("_rows", "_n"), [*SERIES, "block"]).drop("block")


def first_severe(anomalies: DataFrame) -> DataFrame:
    """The earliest anomaly of medium or high severity per series."""
    return (
        anomalies.where(F.col("severity").isin("medium", "high"))
        .groupBy(*SERIES)
        .agg(F.min(F.struct("idx", "ts", "severity", "zscore")).alias("a"))
        .select(*SERIES, "a.ts", "a.severity", "a.zscore")
    )


def open_since(events: DataFrame, cutoff: Column) -> DataFrame:
    """Stations with an open alert whose onset lies after ``cutoff``."""
    return events.where((F.col("status") == "open") & (F.col("onset_ts") > cutoff)).select("station_id").distinct()


def suppress_duplicates(candidates: DataFrame, events: DataFrame, hours: int = SUPPRESS_H) -> DataFrame:
    """Candidates (station_id, ts) without an open alert of the station in the ``hours`` up to ``ts``.

    The latest open onset as of each candidate decides, so the work is one ordered pass over blocks of
    time and never pairs a station's candidates with its alerts.
    """
    onsets = (
        events.where(F.col("status") == "open")
        .select("station_id", F.col("onset_ts").alias("ts"), F.lit(0.0).alias("value"))
        .distinct()
    )
    moments = candidates.select("station_id", F.col("ts").alias("at"))
    seen = asof_facts(onsets, moments, keys=["station_id"], inclusive=True).select(
        "station_id", F.col("at").alias("ts"), F.col("last_ts").alias("_last")
    )
    recent = F.col("_last") > F.col("ts") - F.make_dt_interval(hours=F.lit(hours))
    return (
        candidates.join(seen, ["station_id", "ts"], "left")
        .where(~F.coalesce(recent, F.lit(False)))
        .select(*candidates.columns)
    )


def next_moments(moments: DataFrame, hours: int, block_seconds: int = DAY) -> DataFrame:
    """(station_id, ts, next): the first of ``moments(station_id, ts)`` of the station that lies ``hours`` or more after ts.

    Moments and the times asked for are ordered inside (station, block) only; what lies in later blocks is one row per
    block. Moments without a later one have no row. Moments are distinct and hold no nulls.
    """
    sought = F.timestamp_micros(F.unix_micros("ts") + F.lit(hours * 3_600_000_000))
    nothing = F.lit(None).cast("timestamp")
    rows = (
        moments.select("station_id", F.col("ts").alias("at"), F.col("ts").alias("seen"), nothing.alias("asked"))
        .unionByName(moments.select("station_id", sought.alias("at"), nothing.alias("seen"), F.col("ts").alias("asked")))
        .withColumn("block", time_block("at", block_seconds))
    )
    later = Window.partitionBy("station_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("station_id", "block").agg(F.min("seen").alias("_first"))
        .select("station_id", "block", F.last("_first", ignorenulls=True).over(later).alias("_after"))
    )
    backward = running(Window.partitionBy("station_id", "block").orderBy(F.desc("at"), F.col("seen").isNull()))
    local = rows.withColumn("_within", F.last("seen", ignorenulls=True).over(backward)).where("asked IS NOT NULL")
    return (
        local.join(blocks, ["station_id", "block"])
        .select("station_id", F.col("asked").alias("ts"), F.coalesce("_within", "_after").alias("next"))
        .where("next IS NOT NULL")
    )


def suppression_chain(
    alerts: DataFrame, hours: int = SUPPRESS_H, silenced: DataFrame | None = None, block_seconds: int = DAY
) -> DataFrame:
    """The rows of ``alerts`` (id, station_id, ts, ...) that are raised if each raised one silences its station for ``hours``.

    Which alert comes next after a raised one is the same whoever asks, so the chain of a station is a walk along links.
    Each round doubles both the stretch that is known and the length of the links: a year of alerts takes eight rounds
    and not one for each alert raised, and no station's alerts are ever gathered. ``silenced`` (station_id, until) holds
    stations that are still silent up to and including ``until``. Of alerts at one time that with the smallest id is raised,
    of equal rows one. An alert without station or time is always raised and silences nothing.
    """
    known = not_null("station_id", "ts")
    moments = alerts.where(known).select("station_id", "ts").distinct()
    if silenced is not None:
        until = silenced.where(not_null("station_id", "until")).groupBy("station_id").agg(F.max("until").alias("_until"))
        moments = moments.join(until, "station_id", "left").where("_until IS NULL OR ts > _until").drop("_until")
    moments = cut_lineage(moments)
    raised = cut_lineage(moments.groupBy("station_id").agg(F.min("ts").alias("ts")))
    links = next_moments(moments, hours, block_seconds)
    # A moment that no link leads to is on no chain, unless it is the first; many links lead to the same one.
    links = cut_lineage(links)
    on_way = links.select("station_id", F.col("next").alias("ts")).unionByName(raised).distinct()
    links = cut_lineage(links.join(on_way, ["station_id", "ts"], "left_semi"))
    while not links.isEmpty():
        ahead = raised.join(links, ["station_id", "ts"]).select("station_id", F.col("next").alias("ts"))
        raised = cut_lineage(raised.unionByName(ahead))
        second = links.select("station_id", F.col("ts").alias("next"), F.col("next").alias("_next"))
        links = cut_lineage(links.join(second, ["station_id", "next"]).select("station_id", "ts", F.col("_next").alias("next")))
    whole = F.struct(*[F.col(c) for c in alerts.columns])
    first = alerts.where(known).groupBy("station_id", "ts").agg(F.min_by(whole, F.struct("id")).alias("_row"))
    return first.join(raised, ["station_id", "ts"]).select("_row.*").unionByName(alerts.where(~known))


def scan_for_events(
    readings: DataFrame,
    stations: DataFrame,
    events: DataFrame,
    window_h: int = 24,
    method: str = "cusum",
    min_samples: int = MIN_SAMPLES,
    **settings,
) -> DataFrame:
    """New alert events over all series in one plan.

    Indicators of a station are taken in the station's order. An alert with an onset inside the
    suppression time silences the later indicators of its station, as one already open does.
    """
    now = latest_time(readings)
    # The look-back is a small share of the readings and the detector reads it more than once.
    recent = cut_lineage(enough_samples(recent_readings(readings, window_h, now), min_samples))
    found = first_severe(detect(recent, method, **settings))
    order = stations.select(F.col("id").alias("station_id"), F.posexplode("indicators").alias("pos", "indicator"))
    cutoff = now - F.make_dt_interval(hours=F.lit(SUPPRESS_H))
    earlier = Window.partitionBy("station_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    silenced = F.coalesce(F.max((F.col("ts") > cutoff).cast("int")).over(earlier), F.lit(0))
    key = F.concat_ws("|", "station_id", "indicator", F.unix_micros("ts").cast("string"))
    return (
        found.join(order, ["station_id", "indicator"])
        .join(open_since(events, cutoff), "station_id", "left_anti")
        .withColumn("_silenced", silenced)
        .where("_silenced = 0")
        .select(
            F.sha2(key, 256).alias("id"),
            "station_id",
            F.array("indicator").alias("indicators"),
            F.col("ts").alias("onset_ts"),
            "severity",
            F.lit("detected").alias("etype"),
            F.lit(None).cast("string").alias("truth_source"),
            F.lit("open").alias("status"),
            "zscore",
        )
    )
