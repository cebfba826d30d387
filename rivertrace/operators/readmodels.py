"""Read models: series slices, event lists, map layers, contrasts, playback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace.operators.blocks import DAY, SERIES, asof_facts, not_null, time_block, with_positions

PLAYBACK_BEFORE_H, PLAYBACK_AFTER_H = 6, 48  # fixed values: playback window around an onset


def station_series(
    readings: DataFrame, station: str, indicator: str, since: Column, limit: int | None = None
) -> DataFrame:
    """(ts, value) of one series from ``since``, oldest first, all of it unless a ``limit`` is asked for; the
    three conditions reach the scan."""
    wanted = (F.col("station_id") == station) & (F.col("indicator") == indicator) & (F.col("ts") >= since)
    rows = readings.where(wanted).select("ts", "value").orderBy("ts", "value")
    return rows if limit is None else rows.limit(limit)


def series_from(readings: DataFrame, since: Column, limit: int | None = None, block_seconds: int = DAY) -> DataFrame:
    """The same for every series at once: the readings of each from ``since`` with their positions."""
    recent = with_positions(readings.where(F.col("ts") >= since), block=time_block("ts", block_seconds))
    kept = recent if limit is None else recent.where(F.col("idx") < limit)
    return kept.select(*SERIES, "ts", "value", "idx")


def series_slice(
    readings: DataFrame, start: Column | None = None, end: Column | None = None, step: int = 1, block_seconds: int = DAY
) -> DataFrame:
    """Every series cut to [start, end] and thinned to rows 0, step, 2*step ...; ``count`` is the rows kept."""
    rows = readings
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") <= end)
    if step == 1:  # only the count is needed, not the order
        sizes = rows.where(not_null(*SERIES, "ts")).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("count"))
        return rows.join(sizes, list(SERIES)).where("ts IS NOT NULL").select(*SERIES, "ts", "value", "count")
    placed = with_positions(rows, block=time_block("ts", block_seconds)).where(F.col("idx") % step == 0)
    return placed.select(*SERIES, "ts", "value", F.ceil(F.col("n") / step).alias("count"))


def list_events(events: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest onset first; id breaks ties."""
    rows = events if status is None else events.where(F.col("status") == status)
    return rows.orderBy(F.desc("onset_ts"), "id").limit(limit)


def lookup(requests: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Left join on ``key`` with a ``found`` flag that tells a missing row from a row of nulls."""
    return requests.join(table.withColumn("found", F.lit(True)), key, "left").fillna(False, ["found"])


def latest_per_key(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row per key of an append-only log; a partial aggregate, not a window over the key."""
    whole = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def upsert_readings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-replace on (station_id, indicator, ts). Both sides carry a ``version``; the newest wins."""
    key = [*SERIES, "ts"]
    return old.unionByName(new).groupBy(*key).agg(F.max_by("value", "version").alias("value"))


def enterprise_profiles(enterprises: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Enterprise with its fingerprint, null where none is on file."""
    return enterprises.join(fingerprints.withColumnRenamed("enterprise_id", "id"), "id", "left")


def map_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line features; an edge with a missing end drops out."""
    a = nodes.select(F.col("id").alias("from_node"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("to_node"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "from_node").join(b, "to_node").select("from_node", "to_node", "x1", "y1", "x2", "y2")


def map_points(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places (with node_id) at their node's position; a place without a node drops out."""
    at = nodes.select(F.col("id").alias("node_id"), "x", "y")
    return places.join(at, "node_id")


def station_layer(stations: DataFrame, nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Station points with ``alert`` set where an event is not resolved."""
    flagged = (
        events.where(F.col("status") != "resolved").select(F.col("station_id").alias("id")).distinct()
        .withColumn("alert", F.lit(True))
    )
    return map_points(stations, nodes).join(flagged, "id", "left").fillna(False, ["alert"])


def enterprise_layer(enterprises: DataFrame, nodes: DataFrame, locked: DataFrame) -> DataFrame:
    """Enterprise points with ``locked`` set for the sources of resolved verdicts (column source_id)."""
    found = locked.select(F.col("source_id").alias("id")).distinct().withColumn("locked", F.lit(True))
    return map_points(enterprises, nodes).join(found, "id", "left").fillna(False, ["locked"])


def nodes_without_station(nodes: DataFrame, stations: DataFrame) -> DataFrame:
    return nodes.join(stations.select(F.col("node_id").alias("id")), "id", "left_anti")


def event_contrast(
    readings: DataFrame, events: DataFrame, stations: DataFrame, min_ratio: float = 1.3, block_seconds: int = DAY
) -> DataFrame:
    """Mean before onset against maximum from onset, per event and indicator of its station.

    Both come from one as-of pass over the readings, shared by all events with the same station and
    onset, instead of a scan of the history per event.
    """
    watched = stations.select(F.col("id").alias("station_id"), F.explode("indicators").alias("indicator"))
    onsets = events.select("station_id", F.col("onset_ts").alias("at")).distinct()
    facts = asof_facts(readings, onsets.join(watched, "station_id"), inclusive=False, block_seconds=block_seconds)
    contrasts = (
        facts.withColumn("before", F.try_divide("sum_before", "n_before"))
        .where((F.col("before") != 0) & (F.col("max_from") != 0))
        .where(F.col("max_from") > F.col("before") * min_ratio)
        .select(*SERIES, F.col("at").alias("onset_ts"), "before", F.col("max_from").alias("after"))
        .withColumn("ratio", F.try_divide("after", "before"))
    )
    return events.join(contrasts, ["station_id", "onset_ts"])


def baseline_summary(readings: DataFrame, before: Column) -> DataFrame:
    """Mean, minimum and maximum per station and indicator up to a time."""
    return (
        readings.where(F.col("ts") < before)
        .groupBy(*SERIES)
        .agg(
            F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        )
    )


def top_peaks(readings: DataFrame, before: Column, count: int = 5) -> DataFrame:
    """The ``count`` largest readings of each series up to a time.

    Spark keeps ``count`` rows per series and partition ahead of the shuffle (window group limit).
    """
    order = Window.partitionBy(*SERIES).orderBy(F.desc("value"), "ts")
    return (
        readings.where(F.col("ts") < before)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= count)
    )


def window_peak(readings: DataFrame, windows: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Largest value per station inside each (indicator, t0, t1), both ends included.

    Whole buckets come from bucket maxima; only the two end buckets are read row by row.
    """
    width = bucket_s * 1_000_000

    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / width)

    keys = ["indicator", "t0", "t1"]
    wanted = windows.select(*keys).distinct()
    full_from = F.ceil(F.unix_micros("t0") / width)
    full_to = bucket(F.col("t1")) - 1
    maxima = readings.groupBy("station_id", "indicator", bucket(F.col("ts")).alias("b")).agg(F.max("value").alias("value"))
    inner = (
        wanted.where(full_from <= full_to)
        .withColumn("b", F.explode(F.sequence(full_from, full_to)))
        .join(maxima, ["indicator", "b"])
        .select("station_id", *keys, "value")
    )
    ends = wanted.withColumn("b", F.explode(F.array_distinct(F.array(bucket(F.col("t0")), bucket(F.col("t1"))))))
    edge = (
        ends.join(readings.withColumn("b", bucket(F.col("ts"))), ["indicator", "b"])
        .where((F.col("ts") >= F.col("t0")) & (F.col("ts") <= F.col("t1")))
        .select("station_id", *keys, "value")
    )
    return inner.unionByName(edge).groupBy("station_id", *keys).agg(F.max("value").alias("peak"))


def playback_heat(
    readings: DataFrame, events: DataFrame, stations: DataFrame, step_s: int = 3600, block_seconds: int = DAY
) -> DataFrame:
    """Heat of every station at each time step around an onset: value as of the step over the window's peak.

    ``events`` has indicator and onset_ts; events that share both share one playback. 0 where a station
    has no reading yet, capped at 1.
    """
    span = F.make_dt_interval(hours=F.lit(PLAYBACK_BEFORE_H)), F.make_dt_interval(hours=F.lit(PLAYBACK_AFTER_H))
    windows = events.select(
        "indicator", "onset_ts", (F.col("onset_ts") - span[0]).alias("t0"), (F.col("onset_ts") + span[1]).alias("t1")
    ).distinct()
    steps = F.sequence(F.col("t0"), F.col("t1"), F.make_dt_interval(secs=F.lit(step_s)))
    watched = stations.select(F.col("id").alias("station_id"), F.explode("indicators").alias("indicator"))
    frames = windows.join(watched, "indicator").withColumn("at", F.explode(steps))
    seen = asof_facts(readings, frames.select(*SERIES, "at"), inclusive=True, block_seconds=block_seconds)
    peaks = window_peak(readings, windows)
    current = F.when(F.col("last_ts") >= F.col("t0"), F.col("last_value")).otherwise(0.0)
    heat = F.when(F.col("peak") > 0, F.least(current / F.nullif(F.col("peak"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return (
        frames.join(seen, [*SERIES, "at"], "left")
        .join(peaks, ["station_id", "indicator", "t0", "t1"], "left")
        .select("indicator", "onset_ts", "station_id", "at", F.coalesce(current, F.lit(0.0)).alias("value"), F.coalesce(heat, F.lit(0.0)).alias("heat"))
    )
