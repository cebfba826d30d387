"""Exact medians and robust scales that do not gather a series in one task.

Values are first reduced to (key, value, count). A value's bin is a pure, order-preserving function of
the value (sign, binary exponent, leading 14 bits of the mantissa), so the middle rank is located over
the short list of bins, and only the distinct values of the one or two middle bins are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace.operators.blocks import not_null

_STEPS = 1 << 14


def value_bin(value: Column) -> Column:
    """Order-preserving bin of a double: x <= y implies bin(x) <= bin(y)."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * _STEPS)
    level = (exponent + 1100) * _STEPS + F.greatest(F.lit(0), F.least(F.lit(_STEPS - 1), step))
    signed = F.when(size == 0, F.lit(0)).otherwise(F.signum(value) * level).cast("bigint")
    return F.coalesce(signed, F.lit(0))


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, v, c): distinct values with their counts.

    Null keys are dropped here, as later joins would do, so that every use of the table plans the same
    exchange and Spark reuses it.
    """
    return (
        df.where(not_null(*keys, value))
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def median_of_counts(counts: DataFrame, keys: Sequence[str], name: str = "median") -> DataFrame:
    """Exact median per key of a (keys, v, c) table."""
    keys = list(keys)
    binned = counts.withColumn("bin", value_bin(F.col("v")))
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    bins = (
        binned.groupBy(*keys, "bin")
        .agg(F.sum("c").alias("c"))
        .withColumn("upto", F.sum("c").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("c").over(Window.partitionBy(*keys)))
        .withColumn("lo", F.floor((F.col("total") - 1) / 2))
        .withColumn("hi", F.floor(F.col("total") / 2))
        .where((F.col("upto") > F.col("lo")) & (F.col("upto") - F.col("c") <= F.col("hi")))
        .select(*keys, "bin", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi")
    )
    by_value = Window.partitionBy(*keys, "bin").orderBy("v")
    return (
        binned.join(bins, [*keys, "bin"])
        .withColumn(
            "upto",
            F.col("below") + F.sum("c").over(by_value.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("upto") > F.col("lo"), F.col("v"))).alias("_lo"),
            F.min(F.when(F.col("upto") > F.col("hi"), F.col("v"))).alias("_hi"),
        )
        .select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "median") -> DataFrame:
    return median_of_counts(value_counts(df, keys, value), keys, name)


def robust_scale(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per key: ``median`` and ``sigma`` = max(1.4826 * MAD, 1e-9)."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    centre = median_of_counts(counts, keys)
    # The median reaches the values through (key, bin): a join on the key alone would put all values of
    # a busy series in one task.
    binned = counts.withColumn("bin", value_bin(F.col("v")))
    per_bin = binned.select(*keys, "bin").distinct().join(centre, keys)
    spread = (
        binned.join(per_bin, [*keys, "bin"])
        .groupBy(*keys, F.abs(F.col("v") - F.col("median")).alias("v"))
        .agg(F.sum("c").alias("c"))
    )
    mad = median_of_counts(spread, keys, "mad")
    return centre.join(mad, keys).select(
        *keys, "median", F.greatest(F.col("mad") * 1.4826, F.lit(1e-9)).alias("sigma")
    )
