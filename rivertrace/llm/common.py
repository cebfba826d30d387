"""Helpers shared by the operators: tables, batches of text, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from rivertrace.session import write_once

# Executors need not have this package: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about ``limit`` bytes of text (one long text may exceed it).

    A worker's memory then depends on the longest text and not on how many rows a batch has.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


BROADCAST_BYTES = 16 << 20


def _words(kind: DataType) -> int:
    return 2 + sum(_words(field.dataType) for field in kind.fields) if isinstance(kind, StructType) else 1


def sized_broadcast(keys: DataFrame) -> DataFrame:
    """Marks a saved table of numbers for broadcasting if its count and the width of its rows show that it is small, as
    the driver has to hold all of it; a larger one is left to Spark, which then shuffles. The rows of a join are the same
    either way."""
    width = 16 + 8 * _words(keys.schema)
    return F.broadcast(keys) if keys.count() * width <= BROADCAST_BYTES else keys


def content_key(text: Column | str) -> Column:
    """Stands for a text in grouping and joining: 256 bits, so equal keys mean equal texts. Null stays null."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def packed(docs: DataFrame) -> DataFrame:
    """(row_, doc_id, text): everything but the text in one struct, so that no column of the caller can clash
    with one of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def unpacked(rows: DataFrame, columns: list[str], added: tuple[str, ...] = ()) -> DataFrame:
    """The caller's columns in their order, then ``added``, which replace columns of the same name."""
    own = [F.col("text") if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in columns if c not in added]
    return rows.select(*own, *added)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def _near_stars(edges: DataFrame) -> DataFrame:
    """A large and a small star of few edges: what each node meets is broadcast, so that edges stay where they are. Repeated
    edges stay repeated."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    around = both.groupBy(F.col("e.a").alias("b")).agg(F.least(F.min("e.b"), F.col("b")).alias("m"))
    down = ends.join(F.broadcast(around), "b").select("a", F.col("m").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(F.broadcast(least), "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def discard(saved: DataFrame) -> None:
    """Empties a table of ``write_once`` that nothing reads any more, so that it takes no room until the application ends."""
    files = saved.inputFiles()
    if files:
        saved.sparkSession.createDataFrame([], saved.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


ROUNDS, LEADS, BLOCK_ROWS = 3, 4, 1000


def lists_apart(rows: DataFrame, *more: Column) -> DataFrame:
    """The keys of ``rows(key, root, ..)`` under which different roots meet, and ``more`` of each."""
    lists = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *more)
    return lists.filter("low <> high").drop("low", "high")


def rooted(index: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``index`` with the root of each node's component of ``links``, and the links of nodes to their roots."""
    roots = write_once(connected_components(links), f"{name}_roots")
    rows = index.join(sized_broadcast(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def lead_links(
    index: DataFrame, links: DataFrame, may: Callable[[Column, Column], Column], check: Callable[[DataFrame], DataFrame], name: str, worth: float = 0
) -> DataFrame:
    """(a, b): ``links`` and more, which join most alike nodes of ``index(key, node, about)`` into components.

    In each of ``ROUNDS`` the nodes of a key are compared with one of them, its lead, if they are not in one component
    yet. ``may`` says of two ``about`` whether their nodes can be alike, ``check`` keeps the alike ones of pairs
    (x, y). A group of n alike nodes so gives some n pairs and not their square. The lead is drawn by a hash, in
    ``LEADS`` ways for different keys, so that nodes which share all keys meet as many. Leads are found by a
    combined aggregate; under a hot key the rows stay where they are until they meet its lead, and Spark splits that join.
    No round follows one of whose pairs less than the part ``worth`` were alike; what is still apart is the caller's to compare.
    """
    for turn in range(ROUNDS):
        rows, links = rooted(index, links, name)
        lead = F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(LEADS)), "node", F.lit(turn)).alias("h"), "node", "root", "about")).alias("lead")
        lists = write_once(lists_apart(rows, lead), f"{name}_lists")
        if lists.isEmpty():
            break
        met = rows.join(sized_broadcast(lists), "key").filter((F.col("root") != F.col("lead.root")) & may(F.col("about"), F.col("lead.about")))
        pairs = write_once(met.select(F.col("node").alias("x"), F.col("lead.node").alias("y")).distinct(), f"{name}_pairs")
        before = links.count() if worth else 0
        links = write_once(links.union(check(pairs).select("x", "y")), f"{name}_links")
        if worth and links.count() - before < worth * pairs.count():
            break
    return links


def list_parts() -> Column:
    """``parts``: into how many the rows of a key are cut for ``in_blocks``."""
    return F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")


def in_blocks(rows: DataFrame, *kept: str) -> DataFrame:
    """(key, low, high, side, ``kept``): every two of ``rows(key, node, parts, ..)`` with one key share a block (key, low, high) of
    at most some 2 * ``BLOCK_ROWS`` rows, partitioned by block and sorted by side. Two rows of one part of a list
    share the block low = high; of two parts, ``side`` tells them apart."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cut = rows.withColumn("own", own)
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = each.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), *kept)
    return block.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side")


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` saved, with their number and the sum of their hashes, which are taken as they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    saved = write_once(edges.observe(seen, F.count(F.lit(1)).alias("edges"), total.alias("total")), name)
    return saved, (seen.get.get("edges", 0), seen.get.get("total"))


#: Up to so many edges a round of ``connected_components`` broadcasts.
STAR_EDGES = 1 << 16


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates large and small stars until nothing changes. A node's neighbours are only ever reduced to
    their minimum, which Spark combines before the shuffle, so a hub is no hot key. Each round is a table
    in the shared folder and one query: every exchange of a query takes the driver a thread for a minute.
    """
    now, state = _counted(edges.filter("a <> b").select("a", "b"), "edges")
    before = None
    while state[0] and state != before:
        before = state
        now, state = _counted(_near_stars(now) if state[0] <= STAR_EDGES else _small_star(_large_star(now)), "stars")
    if state[0] <= STAR_EDGES:
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
        return now.select(F.inline(ends)).distinct()
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
