"""Anomaly detectors over (station, indicator) series.

Each takes readings (station_id, indicator, ts, value) and returns one row per anomaly:
station_id, indicator, idx, ts, value, baseline, zscore, severity (unrounded; see anomaly_record).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace.functions.detection import severity
from rivertrace.operators.blocks import (
    DAY, SERIES, attach_positions, running, tile_window, time_block, with_blocks,
    with_positions, with_tiles,
)
from rivertrace.operators.quantiles import robust_scale

TILE = 4096


def _anomalies(df: DataFrame, baseline: Column, zscore: Column) -> DataFrame:
    scored = df.select(*SERIES, "idx", "ts", "value", baseline.alias("baseline"), zscore.alias("zscore"))
    return scored.withColumn("severity", severity(F.col("zscore"), F.col("value"), F.col("baseline")))


def anomaly_record(anomalies: DataFrame) -> DataFrame:
    """The published form: value and baseline at 4 decimals, z-score at 2, half to even."""
    return anomalies.select(
        *SERIES, "idx", "ts",
        F.bround("value", 4).alias("value"),
        F.bround("baseline", 4).alias("baseline"),
        F.bround("zscore", 2).alias("zscore"),
        "severity",
    )


def rolling_stats(
    readings: DataFrame, window: int = 144, block_seconds: int = DAY, tile: int = TILE
) -> DataFrame:
    """Centred rolling mean and population deviation over ``window`` positions.

    Near the ends a point takes the first or last full window. Each window is summed afresh from central
    moments, so a single wild reading weighs only on the windows that hold it, and a window of equal
    values gets deviation zero exactly.
    """
    left, right = window // 2, window - 1 - window // 2
    indexed = with_positions(readings, block=time_block("ts", block_seconds)).where(F.col("n") >= window)
    tiles = with_tiles(indexed, max(tile, window), before=window, after=window)
    around = tile_window().rowsBetween(-left, right)
    moments = tiles.withColumn("_mean", F.avg("value").over(around)).withColumn("_std", F.stddev_pop("value").over(around))
    whole = Window.partitionBy(*SERIES, "tile")
    first_full, last_full = F.lit(left), F.col("n") - 1 - right

    def clamped(column: str) -> Column:
        head = F.max(F.when(F.col("idx") == first_full, F.col(column))).over(whole)
        tail = F.max(F.when(F.col("idx") == last_full, F.col(column))).over(whole)
        return (
            F.when(F.col("idx") < first_full, head)
            .when(F.col("idx") > last_full, tail)
            .otherwise(F.col(column))
        )

    return (
        moments.withColumn("mean", clamped("_mean"))
        .withColumn("std", F.greatest(clamped("_std"), F.lit(1e-12)))
        .where("own")
        .select(*SERIES, "idx", "ts", "value", "mean", "std")
    )


def detect_threesigma(
    readings: DataFrame, window: int = 144, k: float = 3.0, block_seconds: int = DAY, tile: int = TILE
) -> DataFrame:
    stats = rolling_stats(readings, window, block_seconds, tile)
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return _anomalies(stats, F.col("mean"), z).where(F.abs("zscore") > k)


def cusum_path(
    readings: DataFrame,
    k: float = 0.5,
    h: float = 7.0,
    warmup: float = 0.1,
    block_seconds: int = DAY,
    warmup_rows: int | None = None,
) -> DataFrame:
    """Every reading with its two-sided CUSUM statistic ``z`` and the one before it, ``previous``.

    Target and scale are the median and robust sigma of the first max(int(n * warmup), 10) points, or
    of the first ``warmup_rows`` points where given.
    """
    blocked = with_blocks(readings, block=time_block("ts", block_seconds))
    indexed = attach_positions(blocked)
    head = (
        F.greatest(F.floor(F.col("n") * F.lit(warmup)), F.lit(10))
        if warmup_rows is None
        else F.lit(warmup_rows)
    )
    facts = robust_scale(indexed.where(F.col("idx") < head), SERIES)
    return cusum_scan(attach_positions(blocked, facts=facts), k, h)


def cusum_scan(indexed: DataFrame, k: float, h: float, starts: DataFrame | None = None) -> DataFrame:
    """CUSUM over positioned rows that carry ``median`` and ``sigma``.

    S = max(0, S' + d - k) is a max-plus recursion. A block is summed up by its total T and by L, the
    value S would end on from a zero start; from a start s the statistic inside the block is
    max(L_i, s + C_i) with C_i the running total, and the start of the next block is max(L, s + T).
    ``starts`` may give S+ and S- at the start of each series (columns up_start, down_start).
    """
    in_block = running(Window.partitionBy(*SERIES, "block").orderBy("idx"))
    scaled = (F.col("value") - F.col("median")) / F.col("sigma")
    rows = (
        indexed.withColumn("_u", scaled - k)
        .withColumn("_w", -scaled - k)
        .withColumn("_cu", F.sum("_u").over(in_block))
        .withColumn("_cw", F.sum("_w").over(in_block))
        .withColumn("_lu", F.col("_cu") - F.least(F.lit(0.0), F.min("_cu").over(in_block)))
        .withColumn("_lw", F.col("_cw") - F.least(F.lit(0.0), F.min("_cw").over(in_block)))
    )
    ends = rows.groupBy(*SERIES, "block").agg(
        F.sum("_u").alias("_tu"), F.sum("_w").alias("_tw"),
        F.max(F.struct("idx", "_lu", "_lw")).alias("_end"),
    )
    blocks = Window.partitionBy(*SERIES).orderBy("block")
    carry = ends.withColumn("_au", F.sum("_tu").over(running(blocks))).withColumn(
        "_aw", F.sum("_tw").over(running(blocks))
    )
    if starts is None:
        carry = carry.withColumn("up_start", F.lit(0.0)).withColumn("down_start", F.lit(0.0))
    else:
        carry = carry.join(starts, list(SERIES), "left").fillna(0.0, ["up_start", "down_start"])
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)

    def start(total: str, upto: str, end: str, initial: str) -> Column:
        best = F.max(F.col("_end")[end] - F.col(upto)).over(earlier)
        return F.col(upto) - F.col(total) + F.greatest(F.coalesce(best, F.col(initial)), F.col(initial))

    carry = carry.select(
        *SERIES, "block",
        start("_tu", "_au", "_lu", "up_start").alias("_su"),
        start("_tw", "_aw", "_lw", "down_start").alias("_sw"),
    )
    order = Window.partitionBy(*SERIES, "block").orderBy("idx")
    return (
        rows.join(carry, [*SERIES, "block"])
        .withColumn("up", F.greatest("_lu", F.col("_su") + F.col("_cu")))
        .withColumn("down", F.greatest("_lw", F.col("_sw") + F.col("_cw")))
        .withColumn("z", F.greatest("up", "down"))
        .withColumn("previous", F.coalesce(F.lag("z").over(order), F.greatest("_su", "_sw", F.lit(0.0))))
        .drop("_u", "_w", "_cu", "_cw", "_lu", "_lw", "_su", "_sw")
    )


def cusum_crossings(path: DataFrame, h: float) -> DataFrame:
    fired = path.where((F.col("z") > h) & (F.col("previous") <= h))
    return _anomalies(fired, F.col("median"), F.col("z") / h)


def detect_cusum(
    readings: DataFrame,
    k: float = 0.5,
    h: float = 7.0,
    warmup: float = 0.1,
    block_seconds: int = DAY,
    warmup_rows: int | None = None,
) -> DataFrame:
    """Points at which the CUSUM statistic rises through ``h``; it is not reset afterwards."""
    return cusum_crossings(cusum_path(readings, k, h, warmup, block_seconds, warmup_rows), h)


def detect_ewma(
    readings: DataFrame, lam: float = 0.3, k: float = 3.0, block_seconds: int = DAY
) -> DataFrame:
    """EWMA chart with time-varying variance around the series' median and robust sigma.

    Inside a tile e_i = r^i * sum(lam * x_j * r^-j) with r = 1 - lam. The margin before a tile is long
    enough for r^margin to drop below double precision, so tiles need no carried state.
    """
    if not 0.0 < lam < 1.0:
        raise ValueError("lam must lie strictly between 0 and 1")
    decay = -math.log1p(-lam)
    margin = max(1, math.ceil(39.5 / decay))
    tile = max(margin, min(1024, int(650 / decay) - margin))
    facts = robust_scale(readings, SERIES)
    indexed = with_positions(readings, block=time_block("ts", block_seconds), facts=facts)
    order = tile_window()
    upto = running(order)
    step = F.col("idx") - F.first("idx").over(upto)
    grown = F.lit(lam) * F.col("value") * F.exp(F.lit(decay) * F.col("_j"))
    start = F.when(F.col("tile") == 0, F.first("value").over(upto) * F.exp(-decay * (F.col("_j") + 1)))
    smoothed = (
        with_tiles(indexed, tile, before=margin)
        .withColumn("_j", step)
        .withColumn(
            "_e",
            F.sum(grown).over(upto) * F.exp(F.lit(-decay) * F.col("_j")) + F.coalesce(start, F.lit(0.0)),
        )
        .where("own")
    )
    variance = (
        F.col("sigma") * F.col("sigma") * (lam / (2 - lam))
        * (1 - F.pow(F.lit(1 - lam), 2 * (F.col("idx") + 1)))
    )
    z = (F.col("_e") - F.col("median")) / F.greatest(F.sqrt(variance), F.lit(1e-12))
    return _anomalies(smoothed, F.col("median"), z).where(F.abs("zscore") > k)


def detect_seasonal(
    readings: DataFrame,
    period: int = 96,
    days: int = 7,
    k: float = 3.0,
    min_history: int = 1,
    block_seconds: int = DAY,
    tile: int = TILE,
) -> DataFrame:
    """Compares a point with up to ``days`` earlier points at the same position of the period."""
    margin = period * days
    indexed = with_positions(readings, block=time_block("ts", block_seconds))
    tiles = with_tiles(indexed, max(tile, margin), before=margin)
    order = tile_window()
    lags = [f"_p{d}" for d in range(1, days + 1)]
    for d, name in enumerate(lags, start=1):
        tiles = tiles.withColumn(name, F.lag("value", period * d).over(order))

    def over_history(term: Callable[[Column], Column]) -> Column:
        total: Column = F.lit(0.0)
        for name in lags:
            total = total + F.coalesce(term(F.col(name)), F.lit(0.0))
        return total

    history = F.least(F.floor(F.col("idx") / period), F.lit(days))
    enough = F.col("_h") >= max(1, min_history)
    scored = (
        tiles.where("own")
        .withColumn("_h", history)
        .withColumn("_mean", F.when(enough, over_history(lambda x: x) / F.col("_h")).otherwise(F.col("value")))
        .withColumn(
            "_std",
            F.when(
                enough,
                F.sqrt(over_history(lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))) / F.col("_h")),
            ),
        )
    )
    z = (F.col("value") - F.col("_mean")) / F.greatest(F.coalesce("_std", F.lit(0.0)), F.lit(1e-12))
    return _anomalies(scored, F.col("_mean"), z).where(F.abs("zscore") > k)


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "threesigma": detect_threesigma,
    "cusum": detect_cusum,
    "ewma": detect_ewma,
    "seasonal": detect_seasonal,
}


def detect(readings: DataFrame, method: str = "cusum", **settings) -> DataFrame:
    """Runs the detector registered under ``method``."""
    if method not in DETECTORS:
        raise ValueError(f"unknown method: {method}")
    return DETECTORS[method](readings, **settings)
