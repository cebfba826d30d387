"""Pollutant compositions: normalising, mixing at stations, min/max similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(pollutants: Column) -> Column:
    """A composition map scaled to sum 1; unchanged where the sum is 0."""
    total = F.aggregate(F.map_values(pollutants), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(pollutants, lambda k, v: F.coalesce(v / F.nullif(total, F.lit(0.0)), v))


def composition_of(outfall_conc: Column, excluded: tuple[str, ...] = ("ph",)) -> Column:
    """Composition from raw concentrations: drop pH, absolute value, square root, scale to sum 1."""
    kept = F.map_filter(outfall_conc, lambda k, v: ~k.isin(*excluded))
    return normalised(F.transform_values(kept, lambda k, v: F.sqrt(F.abs(v))))


def background_mix(sources: DataFrame, compositions: DataFrame) -> DataFrame:
    """Attenuation-weighted mixture at each station, summing to 1: (station_id, component, share).

    ``compositions`` has enterprise_id and a ``pollutants`` map.
    """
    parts = (
        sources.join(compositions, "enterprise_id")
        .select("station_id", "atten", F.explode("pollutants").alias("component", "v"))
        .groupBy("station_id", "component")
        .agg(F.sum(F.col("v") * F.col("atten")).alias("amount"))
    )
    totals = parts.groupBy("station_id").agg(F.sum("amount").alias("total"))
    return parts.join(totals, "station_id").select(
        "station_id", "component", (F.col("amount") / F.nullif(F.col("total"), F.lit(0.0))).alias("share")
    )


def as_map(parts: DataFrame, key: str) -> DataFrame:
    """(key, component, share) rows as one ``pollutants`` map per key; components are few."""
    entries = F.array_sort(F.collect_list(F.struct("component", "share")))
    return parts.groupBy(key).agg(F.map_from_entries(entries).alias("pollutants"))


def component_names(compositions: DataFrame) -> list[str]:
    """Sorted names of all components of a library: a handful of pollutants, as a pivot would list them."""
    names = compositions.select(F.explode(F.map_keys("pollutants")).alias("name")).distinct()
    return sorted(row["name"] for row in names.collect())


def ratio_similarity(x: Column, y: Column) -> Column:
    """Smaller over larger, 1 when both are below 1e-12."""
    high = F.greatest(x, y)
    return F.when(high < 1e-12, 1.0).otherwise(F.least(x, y) / F.nullif(high, F.lit(0.0)))


def composition_score(observed: Column, reference: Column, names: list[str]) -> Column:
    """Mean min/max ratio over the keys of the observation and of the whole library; missing = 0.

    One plain expression per library component, so the sum is compiled. Components only the observation
    has (rare) score 1 where their amount is nil and 0 otherwise.
    """
    def amount(side: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at(side, F.lit(name)), F.lit(0.0))

    total: Column = F.lit(0.0)
    for name in names:
        total = total + ratio_similarity(amount(observed, name), amount(reference, name))
    foreign = F.map_filter(observed, lambda k, v: ~k.isin(*names))
    has_foreign = F.size(F.array_except(F.map_keys(observed), F.array(*[F.lit(n) for n in names]))) > 0
    nil = F.size(F.map_filter(foreign, lambda k, v: v < 1e-12))
    return F.when(has_foreign, (total + nil) / (F.size(foreign) + len(names))).otherwise(total / len(names))


def score_compositions(pairs: DataFrame, observed: DataFrame, library: DataFrame) -> DataFrame:
    """Composition match of given (sample_id, enterprise_id) pairs; samples without data drop out."""
    names = component_names(library)
    return (
        pairs.join(observed.select("sample_id", F.col("pollutants").alias("seen")), "sample_id")
        .join(library.select("enterprise_id", F.col("pollutants").alias("known")), "enterprise_id")
        .withColumn("score", composition_score(F.col("seen"), F.col("known"), names))
        .drop("seen", "known")
    )


def component_shares(parts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, shares): the amounts of ``parts(key, component, amount)`` scaled to sum 1, a struct of one number per name; as
    they are where the sum is 0. Plain sums, so neither a map nor a list is built per key."""
    amounts = [
        F.coalesce(F.sum(F.when(F.col("component") == name, F.col("amount"))).cast("double"), F.lit(0.0)).alias(f"c{i}")
        for i, name in enumerate(names)
    ]
    total: Column = F.lit(0.0)
    for i in range(len(names)):
        total = total + F.col(f"c{i}")
    shares = [F.coalesce(F.col(f"c{i}") / F.nullif(F.col("total"), F.lit(0.0)), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))]
    return parts.groupBy(key).agg(*amounts).withColumn("total", total).select(key, F.struct(*shares).alias("shares"))


def share_score(observed: Column, reference: Column, count: int) -> Column:
    """``composition_score`` of two structs of ``component_shares``; null where one of them is."""
    total: Column = F.lit(0.0)
    for i in range(count):
        total = total + ratio_similarity(observed[f"c{i}"], reference[f"c{i}"])
    return F.when(observed.isNotNull() & reference.isNotNull(), total / count)
