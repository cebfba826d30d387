"""Daily periodicity of a series: lag-one-period correlation and the mean profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace.operators.blocks import (
    DAY, SERIES, asof_facts, tile_window, time_block, with_positions, with_tiles,
)
from rivertrace.session import spread

MIN_ROWS = 200  # fixed value: fewer rows than this give no periodicity evidence
SLICE_DAYS = 21  # fixed value: days of a periodicity slice
TILE_ROWS = 2016


def profile_features(
    pairs: DataFrame, keys: Sequence[str], interval_min: int, period_h: int
) -> DataFrame:
    """Periodicity per key from rows (keys, idx, n, value, past); ``past`` lies one period earlier.

    One pass reduces the rows to moments per (key, phase), combined ahead of the shuffle; the moments of
    the at most ``period`` phases then give both the profile and the correlation.
    """
    keys = list(keys)
    period = period_h * 60 // interval_min
    paired = F.when(F.col("past").isNotNull(), F.col("value"))
    whole = F.col("idx") < F.floor(F.col("n") / period) * period
    phases = (
        pairs.groupBy(*keys, (F.col("idx") % period).alias("phase"))
        .agg(
            F.max("n").alias("n"),
            F.avg(F.when(whole, F.col("value"))).alias("level"),
            F.count("past").cast("double").alias("c"),
            F.coalesce(F.avg(paired), F.lit(0.0)).alias("mx"),
            F.coalesce(F.avg("past"), F.lit(0.0)).alias("my"),
            F.coalesce(F.var_pop(paired), F.lit(0.0)).alias("vx"),
            F.coalesce(F.var_pop("past"), F.lit(0.0)).alias("vy"),
            F.coalesce(F.covar_pop("value", "past"), F.lit(0.0)).alias("cxy"),
            F.min(paired).alias("lo_x"), F.max(paired).alias("hi_x"),
            F.min("past").alias("lo_y"), F.max("past").alias("hi_y"),
        )
        .withColumn("hour", F.col("phase") * interval_min / 60.0)
    )
    night = (F.col("hour") >= 22) | (F.col("hour") < 3)
    total, sum_x, sum_y = F.sum("c"), F.sum(F.col("c") * F.col("mx")), F.sum(F.col("c") * F.col("my"))

    def moment(within: str, left: str, right: str, sums: Column) -> Column:
        spread = F.sum(F.col("c") * (F.col(within) + F.col(left) * F.col(right)))
        return spread - F.try_divide(sums, total)

    shape = phases.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.avg("level").alias("overall"),
        F.stddev_pop("level").alias("sd"),
        F.min_by("hour", F.struct(-F.col("level"), F.col("hour"))).alias("peak_hour"),
        F.avg(F.when(night, F.col("level"))).alias("night_level"),
        F.array_sort(F.collect_list(F.struct("hour", "level"))).alias("levels"),
        moment("vx", "mx", "mx", sum_x * sum_x).alias("sxx"),
        moment("vy", "my", "my", sum_y * sum_y).alias("syy"),
        moment("cxy", "mx", "my", sum_x * sum_y).alias("sxy"),
        (F.max("hi_x") - F.min("lo_x")).alias("range_x"),
        (F.max("hi_y") - F.min("lo_y")).alias("range_y"),
    )
    steady = (F.col("range_x") <= 1e-12) | (F.col("range_y") <= 1e-12)
    r = F.when(steady, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("sxy"), F.sqrt(F.greatest(F.col("sxx") * F.col("syy"), F.lit(0.0)))), F.lit(0.0))
    )
    threshold = F.col("overall") + F.greatest(F.col("sd") * 0.3, F.lit(1e-9))
    active = F.transform(
        F.filter("levels", lambda p: p["level"] > threshold), lambda p: F.bround(p["hour"], 1)
    )
    enough = F.col("n") >= 2 * period
    strength = F.bround(F.greatest(r, F.lit(0.0)), 3)
    return shape.select(
        *keys,
        "n",
        F.lit(period_h).alias("period_h"),
        F.lit(period).alias("period_points"),
        F.when(enough, strength).otherwise(0.0).alias("autocorr"),
        F.when(enough, F.bround("peak_hour", 1)).alias("peak_hour"),
        F.when(enough, active).otherwise(F.array().cast("array<double>")).alias("active_hours"),
        F.when(enough, F.bround(F.col("night_level") / F.greatest(F.col("overall"), F.lit(1e-9)), 3))
        .otherwise(1.0).alias("night_share"),
        F.when(enough, strength).otherwise(0.0).alias("strength"),
    )


def analyze_periodicity(
    readings: DataFrame, interval_min: int = 15, period_h: int = 24, block_seconds: int = DAY, tile: int = 4096
) -> DataFrame:
    """Periodicity of every whole series; phase 0 is the first reading."""
    period = period_h * 60 // interval_min
    indexed = with_positions(readings, block=time_block("ts", block_seconds))
    tiles = with_tiles(indexed, max(tile, period), before=period)
    pairs = tiles.withColumn("past", F.lag("value", period).over(tile_window())).where("own")
    return profile_features(pairs, SERIES, interval_min, period_h)


def periodicity_from(
    readings: DataFrame,
    starts: DataFrame,
    interval_min: int = 15,
    period_h: int = 24,
    days: int = SLICE_DAYS,
    min_rows: int = MIN_ROWS,
    block_seconds: int = DAY,
) -> DataFrame:
    """Periodicity of the readings of a series in the ``days`` from each ``since``.

    ``starts`` has station_id, indicator, since. A slice is cut by time, so denser readings give more rows
    and not fewer days. As-of counts give the positions of its ends; slices meet readings by equality on
    (series, tile). Slices shorter than ``min_rows`` come back with strength 0, night share 1 and
    ``judged`` false.
    """
    period = period_h * 60 // interval_min
    wanted = starts.select(*SERIES, "since").distinct()
    length = F.make_dt_interval(F.lit(days))
    ends = wanted.select(*SERIES, F.explode(F.array("since", F.col("since") + length)).alias("at")).distinct()
    counts = asof_facts(readings, ends, inclusive=False, block_seconds=block_seconds).select(*SERIES, "at", "n_before")
    first = counts.select(*SERIES, F.col("at").alias("since"), F.col("n_before").alias("first"))
    stop = counts.select(*SERIES, (F.col("at") - length).alias("since"), F.col("n_before").alias("stop"))
    found = wanted.join(first, [*SERIES, "since"]).join(stop, [*SERIES, "since"]).where("stop > first")
    slices = found.withColumn(
        "tile", F.explode(F.sequence(F.floor(F.col("first") / TILE_ROWS), F.floor((F.col("stop") - 1) / TILE_ROWS)))
    )
    tiles = with_positions(readings, block=time_block("ts", block_seconds)).withColumn(
        "tile", F.floor(F.col("idx") / TILE_ROWS)
    )
    # Every slice row meets up to ``TILE_ROWS`` readings, so the few slices are spread over all cores first.
    members = (
        spread(slices, *SERIES, "tile").join(tiles.select(*SERIES, "tile", "idx", "value"), [*SERIES, "tile"])
        .where((F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("stop")))
        .withColumn("n", F.col("stop") - F.col("first"))
        .withColumn("idx", F.col("idx") - F.col("first"))
        .where(F.col("n") >= min_rows)
    )
    one_slice = Window.partitionBy(*SERIES, "since").orderBy("idx")
    pairs = members.withColumn("past", F.lag("value", period).over(one_slice))
    found = profile_features(pairs, [*SERIES, "since"], interval_min, period_h)
    return wanted.join(
        found.select(*SERIES, "since", "active_hours", "night_share", "strength", "peak_hour", "n"),
        [*SERIES, "since"],
        "left",
    ).select(
        *SERIES, "since",
        F.coalesce("active_hours", F.array().cast("array<double>")).alias("active_hours"),
        F.coalesce("night_share", F.lit(1.0)).alias("night_share"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"),
        "peak_hour",
        F.coalesce("n", F.lit(0)).alias("used_rows"),
        F.col("n").isNotNull().alias("judged"),
    )
