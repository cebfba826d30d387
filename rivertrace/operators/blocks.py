"""Order-dependent work on long series, cut into time blocks and position tiles.

One series may hold a third of all readings, so no shuffle here is keyed by the series alone. A series
is cut into time blocks; rows are only ever sorted inside a block. What a block must know of the blocks
before it (rows so far, running sums, the last value) is reduced to one row per block, scanned per
series over that small block table, and joined back on (series, block). A block's number comes from
the timestamp alone, so a re-run task rebuilds the same blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("station_id", "indicator")
DAY = 86_400


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def not_null(*columns: str) -> Column:
    condition: Column = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull()
    return condition


def time_block(ts: str | Column = "ts", seconds: int = DAY) -> Column:
    """Number of the block a timestamp falls in; never null, so equal plans stay equal after joins."""
    return F.coalesce(F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint"), F.lit(0))


def suggest_block_seconds(
    readings: DataFrame, target_rows: int = 250_000, keys: Sequence[str] = SERIES, longest: int = 30 * DAY
) -> int:
    """Block length that keeps the busiest series near ``target_rows`` per block.

    One pre-aggregated pass; a single number reaches the driver.
    """
    hourly = readings.groupBy(*keys, time_block("ts", 3600).alias("hour")).count()
    peak = hourly.agg(F.max("count").alias("peak")).first()["peak"] or 1
    return int(max(1, min(longest, 3600 * target_rows / peak)))


def with_positions(
    readings: DataFrame,
    keys: Sequence[str] = SERIES,
    order: str = "ts",
    block: Column | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Adds ``block``, the 0-based position ``idx`` in the series and the series length ``n``.

    ``facts`` (one row per series) ride along on the block table, so they reach the rows of a busy
    series through a join on (series, block) and not on the series.
    """
    keys = list(keys)
    blocked = with_blocks(readings, keys, order, block)
    return attach_positions(blocked, keys, order, facts)


def with_blocks(
    readings: DataFrame, keys: Sequence[str] = SERIES, order: str = "ts", block: Column | None = None
) -> DataFrame:
    present = readings.where(not_null(*keys, order))
    return present.withColumn("block", time_block(order) if block is None else block)


def attach_positions(
    blocked: DataFrame, keys: Sequence[str] = SERIES, order: str = "ts", facts: DataFrame | None = None
) -> DataFrame:
    keys = list(keys)
    sizes = block_offsets(blocked, keys)
    if facts is not None:
        sizes = sizes.join(facts, keys)
    ties = ["value"] if order == "ts" and "value" in blocked.columns else []
    in_block = Window.partitionBy(*keys, "block").orderBy(order, *ties)
    return (
        blocked.withColumn("_rank", F.row_number().over(in_block))
        .join(sizes, [*keys, "block"])
        .withColumn("idx", F.col("_before") + F.col("_rank") - 1)
        .drop("_before", "_rank")
    )


def block_offsets(blocked: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per (series, block): rows in earlier blocks and in the whole series."""
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.groupBy(*keys, "block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "block",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(series).alias("n"),
        )
    )


def with_tiles(
    indexed: DataFrame, size: int, before: int = 0, after: int = 0, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Cuts a positioned series into tiles of ``size`` rows plus a margin on either side.

    Adds ``tile`` and ``own``. Rows near a tile edge are copied into the neighbouring tile with
    ``own`` false; windows over (series, tile) then see every neighbour they need.
    """
    if size < max(before, after):
        raise ValueError("a tile must be at least as long as its margins")
    home = F.floor(F.col("idx") / size)
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - after) / size))
    last = F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("idx") + before) / size))
    return indexed.withColumn("tile", F.explode(F.sequence(first, last))).withColumn(
        "own", F.col("tile") == home
    )


def tile_window(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys, "tile").orderBy("idx")


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def asof_facts(
    readings: DataFrame,
    cursors: DataFrame,
    keys: Sequence[str] = SERIES,
    inclusive: bool = True,
    block_seconds: int = DAY,
) -> DataFrame:
    """What a series held up to each cursor and from it on.

    ``cursors`` has the key columns and ``at``. Per distinct cursor: ``n_before``, ``sum_before``,
    ``last_value`` and ``last_ts`` of the readings before it, ``max_from`` of the readings after. A
    reading at the cursor's own time counts as before it when ``inclusive``, as after it otherwise.
    """
    keys = list(keys)
    marks = cursors.select(
        *keys, F.col("at").alias("ts"), F.lit(None).cast("double").alias("value"),
        F.lit(2 if inclusive else 0).alias("_tag"),
    ).distinct()
    rows = (
        readings.select(*keys, "ts", "value", F.lit(1).alias("_tag"))
        .unionByName(marks)
        .where(not_null(*keys, "ts"))
        .withColumn("block", time_block("ts", block_seconds))
    )
    is_reading = F.col("_tag") == 1
    span = Window.partitionBy(*keys)
    earlier = span.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = span.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys, "block")
        .agg(
            F.sum(is_reading.cast("bigint")).alias("_n"),
            F.sum("value").alias("_s"),
            F.max("value").alias("_m"),
            F.max(F.when(is_reading, F.struct("ts", "value"))).alias("_l"),
        )
        .select(
            *keys,
            "block",
            F.sum("_n").over(earlier).alias("_n0"),
            F.sum("_s").over(earlier).alias("_s0"),
            F.last("_l", ignorenulls=True).over(earlier).alias("_l0"),
            F.max("_m").over(later).alias("_m0"),
        )
    )
    inside = Window.partitionBy(*keys, "block")
    forward = running(inside.orderBy("ts", "_tag"))
    backward = running(inside.orderBy(F.desc("ts"), F.desc("_tag")))
    local = (
        rows.withColumn("_nl", F.sum(is_reading.cast("bigint")).over(forward))
        .withColumn("_sl", F.sum("value").over(forward))
        .withColumn(
            "_ll", F.last(F.when(is_reading, F.struct("ts", "value")), ignorenulls=True).over(forward)
        )
        .withColumn("_ml", F.max("value").over(backward))
        .where(~is_reading)
    )
    latest = F.coalesce("_ll", "_l0")
    return local.join(blocks, [*keys, "block"]).select(
        *keys,
        F.col("ts").alias("at"),
        (F.coalesce("_n0", F.lit(0)) + F.col("_nl")).alias("n_before"),
        (F.coalesce("_s0", F.lit(0.0)) + F.coalesce("_sl", F.lit(0.0))).alias("sum_before"),
        latest["ts"].alias("last_ts"),
        latest["value"].alias("last_value"),
        F.greatest("_ml", "_m0").alias("max_from"),
    )
