"""Shared pieces of the registered queries: the network of a data folder and output forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.operators import attribution as A
from rivertrace.operators import network as N
from rivertrace.operators.blocks import suggest_block_seconds
from rivertrace.session import configure, shared_root, write_once
from rivertrace.sources import tables as T
from rivertrace.sources.stores import path_exists

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class River:
    """Entities of one data folder; the path closure is made when first asked for and then kept.

    ``open_river`` hands out one River per session and folder, so queries on the same network share
    the checkpointed closure. Call ``open_river.cache_clear()`` after changing the network's tables.
    """

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        configure(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(T, name)(self.spark, self.folder)

    def table(self, name: str) -> DataFrame:
        return T.table(self.spark, self.folder, name)

    @cached_property
    def block_seconds(self) -> int:
        """Length of the time blocks of all series queries, from the densest hour of the readings; one
        pre-aggregated pass per folder."""
        return suggest_block_seconds(self.readings)

    @cached_property
    def closure(self) -> DataFrame:
        return N.path_closure(self.nodes, self.edges)

    @cached_property
    def index(self) -> DataFrame:
        """Numbers and ways to the outlet of all nodes; answers for given nodes without the closure."""
        return N.river_index(self.nodes, self.edges)

    @cached_property
    def source_closure(self) -> DataFrame:
        """Paths that start where an enterprise discharges."""
        return N.path_closure(self.nodes, self.edges, self.enterprises.select(F.col("node_id").alias("id")))

    @cached_property
    def impact(self) -> DataFrame:
        return N.impact_matrix(self.source_closure, self.enterprises, self.stations, self.nodes)

    @cached_property
    def sources(self) -> DataFrame:
        return N.upstream_sources(self.impact)

    @cached_property
    def ranked_sources(self) -> DataFrame:
        """At most twelve rows per station; written once, as every alert query starts from it. Spark knows the size of a
        saved table, so alerts are not shuffled to meet it."""
        return write_once(A.station_hypotheses(self.sources), "ranked_sources")


@lru_cache(maxsize=32)
def _river(application: str, spark: SparkSession, folder: str) -> River:
    return River(spark, folder)


def open_river(spark: SparkSession, folder: str) -> River:
    configure(spark)
    shared_root(spark)
    if not path_exists(spark, spark.sparkContext.getCheckpointDir()):
        _river.cache_clear()  # somebody emptied the shared folder: what was kept there is gone
    return _river(spark.sparkContext.applicationId, spark, folder)


open_river.cache_clear = _river.cache_clear


def r(value: Column | str, digits: int) -> Column:
    """Rounds for output. The tiny shift settles exact ties, where summation order decides otherwise."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + 1e-9, digits)


def us(ts: str = "ts") -> Column:
    """Epoch microseconds."""
    return F.unix_micros(F.col(ts))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


EPOCH = "2024-01-01 00:00:00"
