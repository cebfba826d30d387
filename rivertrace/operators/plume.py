"""Spill plumes at downstream nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrace.functions.plume import DISPERSION_M2_S, puff
from rivertrace.functions.timeparts import even_grid
from rivertrace.operators.network import downstream_paths
from rivertrace.session import spread


def plume_paths(spills: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node a spill reaches, with the source's velocity, cross-section and decay rate.

    ``spills`` has spill_id, node_id, mass_kg. The plume keeps the source's velocity on its whole way.
    """
    source = nodes.select(
        F.col("id").alias("src"), "velocity", (F.col("flow") / F.col("velocity")).alias("area_m2"), "k"
    )
    return (
        spills.withColumnRenamed("node_id", "src")
        .join(source, "src")
        .join(downstream_paths(closure), "src")
        .withColumnRenamed("dst", "node_id")
    )


def concentration(hours: Column, dispersion: float = DISPERSION_M2_S) -> Column:
    columns = [F.col(c) for c in ("distance_m", "velocity", "area_m2", "k", "mass_kg")]
    return puff(*columns, hours, dispersion)


def simulate_puff(
    spills: DataFrame, closure: DataFrame, nodes: DataFrame, t_hours: float = 72.0, points: int = 289,
    dispersion: float = DISPERSION_M2_S,
) -> DataFrame:
    """(spill_id, node_id, t_h, c_mgl) at evenly spaced times on all downstream nodes."""
    return (
        spread(plume_paths(spills, closure, nodes), "spill_id", "node_id")
        .withColumn("t", F.explode(even_grid(0.0, t_hours, points)))
        .select("spill_id", "node_id", F.col("t").alias("t_h"), concentration(F.col("t"), dispersion).alias("c_mgl"))
    )


def plume_peaks(curves: DataFrame) -> DataFrame:
    """Largest concentration and the first time it is reached."""
    first = F.min_by("t_h", F.struct(-F.col("c_mgl"), F.col("t_h")))
    return curves.groupBy("spill_id", "node_id").agg(
        F.max("c_mgl").alias("peak_mgl"), first.alias("peak_h")
    )


def puff_at(requests: DataFrame, spills: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Concentration at requested (spill_id, node_id, t_h); 0 where the spill does not pass."""
    paths = plume_paths(spills, closure, nodes).drop("src", "travel_h")
    return requests.join(paths, ["spill_id", "node_id"], "left").select(
        *requests.columns, F.coalesce(concentration(F.col("t_h")), F.lit(0.0)).alias("c_mgl")
    )
