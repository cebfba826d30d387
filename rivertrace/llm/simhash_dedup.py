"""SimHash near-duplicates: byte-position inverted index, count filter, exact verification."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import connected_components, discard, lead_links, lists_apart, pieces, rooted, sized_broadcast, table
from rivertrace.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
WORDS = 3
RADIUS = 2
BYTES = 8
BLOCK = 1 << 16
#: The pipeline stage also links texts of this Jaccard similarity over shingles of so many words.
NEAR_WORDS = 5
SIMILARITY = 0.8
ORDER_DOCS = 10_000
ORDER_COPIES = 10
ORDER_ROWS = 200_000
LEAD_PAIRS = 1000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero for a text without words.

    ``bytes.split`` cuts at space and 0x09-0x0D and ``bytes.lower`` touches A-Z only.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])),
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = np.fromiter((fingerprint(t) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp) for every row; node stands for the text, and a null text has the fingerprint zero."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text")
    return source.mapInArrow(_fingerprints, "doc_id long, node long, fp long")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight byte positions hold the same byte."""
    differing = a.bitwiseXOR(b)
    same = [F.when(differing.bitwiseAND(F.lit(_mask((i,)))) == 0, 1).otherwise(0) for i in range(BYTES)]
    return sum(same[1:], same[0])


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * i) for i in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) for all fingerprints of ``distinct(fp)`` at most ``radius`` bits apart.

    ``radius`` differing bits spoil at most ``radius`` bytes, so such a pair shares at least
    8 - ``radius`` positional bytes: the guaranteed minimum. A posting list of one positional byte
    would hold 1/256 of the corpus; the index therefore enters each fingerprint under every choice of
    that many positions at once, so a list holds only fingerprints that already share the minimum. The
    tally of shared bytes and the Hamming distance are part of the join's condition: a list of m
    fingerprints never leaves the join as m * m rows, only as its true links. Spark takes an explode to give
    a row for each of its input and would broadcast all choices of a table that is small before; hence the hint.
    """
    least = BYTES - radius
    keys = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes"))
        for i, c in enumerate(combinations(range(BYTES), least))
    ])
    index = distinct.select("fp", F.explode(keys).alias("key")).select("key.choice", "key.bytes", "fp").hint("merge")
    a, b = index.alias("a"), index.alias("b")
    near = (
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.bytes") == F.col("b.bytes"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (shared_bytes(F.col("a.fp"), F.col("b.fp")) >= least)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    )
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; a text of fewer words is one shingle."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(words, len(tokens))):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([_lists([shingle_set(t) for t in batch.column("text").to_pylist()])], ["sigs"])


def sketch(found: np.ndarray) -> bytes:
    """For each place (the hash modulo the number of places) whether an odd number of the distinct hashes falls on it.

    The number of places is the power of two from the number of hashes on, 64 at least, so a sketch takes an eighth to a quarter
    of a byte a shingle.
    """
    places = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At most so many hashes are in only one of the two sets that ``a`` and ``b`` are sketches of: such a hash changes one
    place, and hashes in both sets change none. The longer sketch is folded to the length of the shorter."""
    size = 8 * min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count()


def _folded(bits: bytes, size: int) -> int:
    value, now = int.from_bytes(bits, "little"), 8 * len(bits)
    while now > size:
        now //= 2
        value = (value & ((1 << now) - 1)) ^ (value >> now)
    return value


def _prefixes(common, least: float):
    """Of each set the ``n - ceil(least * n) + 1`` members that come first in one order of all shingles, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = common.value
        for batch in pieces(batches):
            sizes, heads, bits = [], [], []
            for t in batch.column("text").to_pylist():
                found = shingle_set(t)
                n = len(found)
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                late = np.where(known[at] == found, ranks[at], -1) if len(known) else np.full(n, -1)
                sizes.append(n)
                heads.append(found[np.lexsort((found, late))][: n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0])
                bits.append(sketch(found))
            columns = [batch.column("node"), pa.array(sizes, pa.int32()), _lists(heads), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "head", "bits"])

    return run


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts share, sorted, and their ranks from rare to frequent.

    They only settle the order in which shingles are indexed, so a bounded sample of texts is enough: under
    any one order no link is lost.
    """
    every = max(1, texts.count() // ORDER_DOCS)
    sample = texts.filter(F.pmod("node", F.lit(every)) == 0).dropDuplicates(["node"])
    found = sample.select("text").mapInArrow(_sets, "sigs array<long>")
    counts = found.select(F.explode("sigs").alias("sig")).groupBy("sig").count().filter(F.col("count") >= ORDER_COPIES)
    counts = write_once(counts, "counts")
    sizes = counts.groupBy("count").agg(F.count(F.lit(1)).alias("sigs")).orderBy(F.desc("count")).collect()
    within = np.cumsum([r["sigs"] for r in sizes]) <= ORDER_ROWS
    # Whole levels of frequency, so that nothing is sorted in the driver; they come as Arrow and not as row objects.
    bound = sizes[int(within.sum()) - 1]["count"] if within.any() else None
    rows = counts.filter(F.col("count") >= F.lit(bound).cast("long")).toArrow()
    rows = rows.sort_by([("count", "ascending"), ("sig", "descending")])
    known = rows.column("sig").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], order


def _sketched(least: float):
    """Of rows (y, x, n, bits), each lead y (x null) before its members x: the pairs that their sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, lead = 0, b""
        for batch in batches:
            found = []
            for y, x, n, bits in zip(*(batch.column(c).to_pylist() for c in ("y", "x", "n", "bits"))):
                if x is None:
                    size, lead = n, bits
                elif differing(bits, lead) <= (n + size) * (1 - least) / (1 + least) + 1e-6:
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])

    return run


def _compared(least: float):
    """Of rows (y, x, text), each lead y (x null) before its members x: the pairs of the similarity ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in pieces(batches):
            found = []
            for y, x, text in zip(*(batch.column(c).to_pylist() for c in ("y", "x", "text"))):
                own = shingle_set(text)
                if x is None:
                    lead = own
                    continue
                shared = len(np.intersect1d(own, lead, assume_unique=True))
                if shared >= (len(own) + len(lead) - shared) * least - 1e-9:
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])

    return run


def _passed(pairs: DataFrame, held: DataFrame, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
    """Those ``pairs(x, y)`` that ``compare`` finds in the rows (y, x, ..) with what ``held(node, ..)`` has of x, or of y where x is null.

    A row of ``held`` is sent once for each pair to where its y is; a y of many pairs is sent to several places.
    """
    own = [c for c in held.columns if c != "node"]
    sizes = write_once(pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / LEAD_PAIRS).cast("int").alias("parts")), "leads")
    dealt = pairs.join(sized_broadcast(sizes), "y").select("y", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), "x")
    members = held.join(sized_broadcast(write_once(dealt, "dealt")), F.col("node") == F.col("x")).select("y", "part", "x", *own)
    leads = sizes.select("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    leads = held.join(sized_broadcast(write_once(leads, "leads")), F.col("node") == F.col("y")).select("y", "part", F.lit(None).cast("long").alias("x"), *own)
    rows = leads.union(members).repartition("y", "part").sortWithinPartitions("y", "part", F.asc_nulls_first("x"))
    return write_once(rows.select("y", "x", *own).mapInArrow(compare, "x long, y long"), name)


def _alike(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those ``pairs(x, y)`` of texts whose shingle sets have the similarity ``least``.

    ``sketches(node, n, bits)`` travel first and rule out most pairs that are not alike, and none that is. Texts travel only for the
    pairs left; their sets are made there and never written.
    """
    pairs = _passed(pairs, sketches, _sketched(least), "possible")
    wanted = write_once(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "wanted")
    kept = write_once(texts.join(sized_broadcast(wanted), "node", "left_semi").dropDuplicates(["node"]), "texts")
    found = _passed(pairs, kept, _compared(least), "alike")
    discard(kept)
    return found


def alike_texts(docs: DataFrame, links: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): ``links`` between texts (by their hashes) and more, so that all texts of five-word Jaccard similarity
    ``least`` or more are in one component.

    Prefix filter: a pair shares a shingle among the first ``n - ceil(least * n) + 1`` of both sets, and of the
    smaller set already among the first ``n - ceil(2 * least / (1 + least) * n) + 1``; where it stands in both
    bounds how many they share. Shingles of one text alone go before anything of them is written. Texts are compared with
    leads, and with each other only where they are still apart after that; pairs whose sketches differ too much need no texts.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text").filter("text is not null")
    common = docs.sparkSession.sparkContext.broadcast(_common(texts))
    heads = texts.mapInArrow(_prefixes(common, least), "node long, n int, head array<long>, bits binary").filter("n > 0").dropDuplicates(["node"])
    heads = write_once(heads, "heads")
    # Only the shared keys may be broadcast: Spark takes the exploded rows to be as few as their texts.
    each = heads.select("node", "n", F.posexplode("head").alias("at", "key")).hint("merge")
    shared = each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key")
    short = F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - 1e-9) + 1
    about = F.struct("n", "at", (F.col("at") < short).alias("indexed")).alias("about")
    index = write_once(each.join(sized_broadcast(write_once(shared, "shared")), "key").select("key", "node", about), "index")
    sketches = write_once(heads.select("node", "n", "bits"), "sketches")
    discard(heads)

    def may(a: Column, b: Column) -> Column:
        needed = F.ceil((a["n"] + b["n"]) * (least / (1 + least)) - 1e-9)
        most = F.least(a["at"], b["at"]) + F.least(a["n"] - a["at"], b["n"] - b["at"])
        return (a["n"] >= b["n"] * least - 1e-9) & (b["n"] >= a["n"] * least - 1e-9) & (most >= needed)

    links = lead_links(index, links, may, lambda pairs: _alike(pairs, texts, sketches, least), "texts")
    rows, links = rooted(index, links, "rest")
    rows = write_once(rows.join(sized_broadcast(write_once(lists_apart(rows), "rest_lists")), "key", "left_semi"), "rest")
    p, q = rows.alias("p"), rows.alias("q")
    a, b = F.col("p.about"), F.col("q.about")
    smaller = (a["indexed"] & (a["n"] <= b["n"])) | (b["indexed"] & (b["n"] <= a["n"]))
    meet = (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root")) & smaller & may(a, b)
    pairs = write_once(p.join(q, meet).select(F.col("p.node").alias("x"), F.col("q.node").alias("y")).distinct(), "rest_pairs")
    found = write_once(links.union(_alike(pairs, texts, sketches, least)), "found")
    discard(index)
    return found


def _classes(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    member = nodes.join(roots, "fp", "left").join(degree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.filter("links > 0").groupBy("root").agg(F.min("first").alias("least"))
    classes = member.join(least, "root", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", "links")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, links): component_id is the smallest doc_id reachable over links of at
    most ``radius`` bits, links the number of other fingerprints linked to this one.

    Texts with one fingerprint stand as one node, so a group of copies costs one row in the join. Null
    and empty texts share the fingerprint zero and are linked like others. Rows without a doc_id keep
    their fingerprint and take the component of others with it (null if there are none).
    """
    rows = write_once(fingerprints(docs), "fingerprints")
    nodes = write_once(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    return _classes(rows, nodes, write_once(linked_fingerprints(nodes.select("fp"), radius), "links"))


def _text_roots(docs: DataFrame, rows: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    """(node, root) of the texts that are linked to others."""
    prints = rows.select("node", "fp").distinct()
    fps = connected_components(write_once(linked_fingerprints(rows.select("fp").distinct(), radius), "links")).withColumnRenamed("node", "fp")
    grouped = write_once(prints.join(fps, "fp", "left").select("node", F.coalesce("root", "fp").alias("group")), "grouped")
    least = grouped.groupBy("group").agg(F.min("node").alias("b"))
    links = write_once(grouped.join(least, "group").filter("node <> b").select(F.col("node").alias("a"), "b"), "text_links")
    return connected_components(links if similarity is None else alike_texts(docs, links, similarity))


def keep_one(docs: DataFrame, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component of texts stays, that with the smallest
    doc_id, of several texts with it the one with the smallest hash.

    Texts are linked within ``radius`` bits of their fingerprints and, with ``similarity``, if the Jaccard similarity
    of their ``NEAR_WORDS``-word shingles is as large. Components are those of texts, so different texts
    under one doc_id are judged apart. A row without a doc_id stays only where its component has no row with
    one. Of rows that repeat id and text one stays.
    """
    rows = write_once(fingerprints(docs), "fingerprints")
    roots = _text_roots(docs, rows, radius, similarity)
    member = rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("copies")).join(roots, "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "node", "copies")
    first = member.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("first")).select("first.doc_id", "first.node", "first.copies")
    first = write_once(first, "kept")

    def of(kept: DataFrame) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (F.xxhash64(docs["text"]) == kept["node"])
        return docs.join(sized_broadcast(kept), same, "left_semi")

    return of(first.filter("copies = 1")).union(of(first.filter("copies > 1")).dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links"
    )


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without near copies: texts within ``RADIUS`` bits or of five-word Jaccard similarity ``SIMILARITY``."""
    return keep_one(docs, similarity=SIMILARITY)


QUERIES = {"op9_simhash_dedup": (query, None)}
