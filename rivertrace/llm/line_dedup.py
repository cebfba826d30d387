"""Line dedup by a segment-partition edit join, verified by banded bit-parallel edit distance."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rivertrace.llm.common import connected_components, in_blocks, lead_links, list_parts, lists_apart, packed, pieces, rooted, sized_broadcast, table, unpacked
from rivertrace.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines are alike within one edit for each CHARS_PER_EDIT code points of the shorter one, EDITS at most: shorter
#: lines than that are alike if they are equal.
EDITS = 2
CHARS_PER_EDIT = 10
PAIR_CELLS = 1 << 21
STEP_CHARS = 1 << 19
STEP_KEYS = 1 << 20
PARTS = 1 << 13
PART_SHIFT = np.uint64(64 - 13)
BATCH_PAIRS = 512
#: Leads go on as long as this part of their pairs is alike; blocks, which join as they compare, do the rest.
LEADS_WORTH = 0.1
SMALL_BLOCK = 16  # blocks of up to so many lines are compared many at a time
_SIGN = 1 << 63


def line_hash(line: str) -> int:
    """Equals Spark's xxhash64 of the same string."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >= _SIGN else h


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else [line.strip(" \t\r") for line in text.split("\n")]


def allowed(length):
    """Edits that lines may differ by of which the shorter has this length."""
    return np.minimum(EDITS, length // CHARS_PER_EDIT)


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, line number): a line's keys are those of its own segments, and of its substrings that can equal a segment of
    a line as long or shorter.

    A line that may differ by k edits from longer ones has k + 1 segments, of which one stays as it was. A key stands
    for the length of the line that has the segment, its place and its letters. Of the shifts a segment can have,
    only those are taken that leave the edits before it to the segments before it and the edits behind it to
    those behind; a pair within k edits has a match among them. All lines take a step at once; substrings are told
    apart by differences of one running sum.
    """
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(n) - n
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    scale = np.full(len(codes) + 1, _BASE, np.uint64)
    back = np.full(len(codes) + 1, _INVERSE, np.uint64)
    scale[0] = back[0] = 1
    scale, back = np.multiply.accumulate(scale), np.multiply.accumulate(back)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * scale[:-1], out=sums[1:])
    keys, owners = [], []
    for gap in range(EDITS + 1):
        for edits in range(max(1, gap), EDITS + 1):
            rows = np.flatnonzero((n - gap > 0) & (allowed(n - gap) == edits))
            whole = n[rows]
            size, longer = np.divmod(whole - gap, edits + 1)
            for i in range(edits + 1):
                late = np.maximum(0, i - (edits + 1 - longer))
                at, length = i * size + late, size + (i >= edits + 1 - longer)
                low = np.maximum(np.maximum(0, at - i), at + gap - (edits - i))
                high = np.minimum(np.minimum(whole - length, at + i), at + gap + (edits - i))
                for shift in range(2 * edits + 1):
                    ok = low + shift <= high
                    if not ok.any():
                        break
                    first = start[rows[ok]] + low[ok] + shift
                    key = (sums[first + length[ok]] - sums[first]) * back[first] + ((whole[ok] - gap) * 16 + i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    keys.append(key ^ (key >> np.uint64(32)))
                    owners.append(rows[ok])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        index, number, value = [], [], []
        for k, t in enumerate(batch.column("text").to_pylist()):
            for i, line in enumerate(lines_of(t)):
                if line:
                    index.append(k)
                    number.append(i)
                    value.append(line_hash(line))
        rows = pa.array(index, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("tk").take(rows), pa.array(number, pa.int32()), pa.array(value, pa.int64())],
            ["doc_id", "tk", "line", "lh"],
        )


def _pairs(keys: list[np.ndarray], nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, first): the distinct pairs in their order; ``first`` tells where a key begins."""
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key)
    key = key[order]
    alone = np.concatenate([[True], key[1:] != key[:-1], [True]])
    several = np.flatnonzero(~(alone[1:] & alone[:-1]))  # only under keys of several rows the nodes' order matters
    order[several] = order[several][np.lexsort((node[order[several]], key[several]))]
    node, first = node[order], alone[:-1]
    new = first.copy()
    new[1:] |= node[1:] != node[:-1]
    return key[new], node[new], first[new]


def _cells(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary cell for each stretch of ``data`` between two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _dealt(key: np.ndarray, node: np.ndarray, part: np.ndarray, known: bool) -> pa.RecordBatch:
    """Pairs in the order of their parts, many to a row."""
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    cuts = np.append(starts, len(part))
    columns = [pa.array(part[starts].astype(np.int32)), pa.array(np.full(len(starts), known)), _cells(key, cuts), _cells(node, cuts)]
    return pa.RecordBatch.from_arrays(columns, ["part", "known", "keys", "nodes"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each distinct line with its hash, dealt into ``PARTS`` by key. Of the lines that share a key within
    a step, two go to the key's part; the others, known to share it, to any."""

    def told(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, first = _pairs(keys, nodes)
        at = np.arange(len(key))
        home = at - np.maximum.accumulate(np.where(first, at, 0)) < 2
        yield _dealt(key[home], node[home], key[home] >> PART_SHIFT, False)
        if not home.all():
            key, node = key[~home], node[~home]
            part = node.view(np.uint64) >> PART_SHIFT
            order = np.argsort(part)
            yield _dealt(key[order], node[order], part[order], True)

    held, owners, size = [], [], 0
    for batch in pieces(batches):
        lines = sorted({x for t in batch.column("text").to_pylist() for x in lines_of(t) if len(x) >= CHARS_PER_EDIT})
        while lines:
            most = int(np.searchsorted(np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))), STEP_CHARS)) + 1
            block, lines = lines[:most], lines[most:]
            keys, rows = line_keys(block)
            held.append(keys.view(np.uint64))
            owners.append(np.fromiter(map(line_hash, block), np.int64, len(block))[rows])
            size += len(keys)
            if size > STEP_KEYS:
                yield from told(held, owners)
                held, owners, size = [], [], 0
    if size:
        yield from told(held, owners)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ``_keyed``, each part in one stretch: (key, node) of the keys that several lines have."""

    def told(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node, first = _pairs(keys, nodes)
        last = np.append(first[1:], True)
        several = ~(first & last)
        return pa.RecordBatch.from_arrays([pa.array(key[several].view(np.int64)), pa.array(node[several])], ["key", "node"])

    held, owners, size, now = [], [], 0, None
    for batch in batches:
        for part, known, keys, nodes in zip(*(batch.column(c) for c in ("part", "known", "keys", "nodes"))):
            key, node = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(nodes.as_buffer(), np.int64)
            if known.as_py():
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])
                continue
            if part.as_py() != now and size > STEP_KEYS:
                yield told(held, owners)
                held, owners, size = [], [], 0
            now = part.as_py()
            held.append(key)
            owners.append(node)
            size += len(key)
    if size:
        yield told(held, owners)


def letter_parity(line: str) -> int:
    """Bit i tells whether the line has an odd number of code points that are i modulo 64. An edit changes at
    most two bits."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4") & 63
    return int(np.packbits(np.bincount(codes, minlength=64) & 1, bitorder="little").view("<i8")[0])


def _with_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "line"):
        lines = batch.column("line").to_pylist()
        columns = [pa.array([letter_parity(x) for x in lines], pa.int64()), pa.array(map(len, lines), pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("line"), *columns], ["node", "line", "parity", "n"])


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line, parity, n) for the lines of ``wanted(node)``."""
    each = docs.select(F.explode_outer(F.split("text", "\n")).alias("line")).select(F.btrim("line", F.lit(" \t\r")).alias("line"))
    found = each.filter(F.length("line") >= CHARS_PER_EDIT).withColumn("node", F.xxhash64("line"))
    once = found.join(sized_broadcast(wanted), "node", "left_semi").dropDuplicates(["node"]).select("node", "line")
    return once.mapInArrow(_with_parity, "node long, line string, parity long, n int")


def _may(a: Column, b: Column) -> Column:
    """By lengths and letter parities; lines that only share a segment, as those of a template do, go here."""
    edits = F.least(F.lit(EDITS), F.floor(F.least(a["n"], b["n"]) / CHARS_PER_EDIT))
    return (F.abs(a["n"] - b["n"]) <= edits) & (F.bit_count(a["parity"].bitwiseXOR(b["parity"])) <= 2 * edits)


def within(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Which pairs of strings are at most ``edits`` apart.

    Banded bit-parallel: a word per pair holds the vertical steps of the 2 * ``edits`` + 1 rows around the
    diagonal; it moves down a row with each column, and the value is followed along the diagonal on which
    the last cell lies. All pairs of a block take the same step at once.
    """
    out = np.zeros(len(left), bool)
    trimmed = []
    for k, (x, y) in enumerate(zip(left, right)):
        a, b = (x, y) if len(x) >= len(y) else (y, x)
        if len(a) - len(b) > edits:
            continue
        p, q = np.frombuffer(a.encode("utf-32-le"), "<u4"), np.frombuffer(b.encode("utf-32-le"), "<u4")
        n = len(q)
        differ = np.flatnonzero(p[:n] != q)
        start = int(differ[0]) if len(differ) else n
        p, q = p[start:], q[start:]
        n = len(q)
        differ = np.flatnonzero(p[len(p) - n :] != q)
        stop = n - 1 - int(differ[-1]) if len(differ) else n
        p, q = p[: len(p) - stop], q[: n - stop]
        if not len(q):
            out[k] = len(p) <= edits
        else:
            trimmed.append((len(p), k, p, q))
    trimmed.sort(key=lambda t: t[:2])
    at = 0
    while at < len(trimmed):
        longest = trimmed[min(len(trimmed), at + 4096) - 1][0]
        block = trimmed[at : at + max(1, min(4096, PAIR_CELLS // longest))]
        at += len(block)
        out[[t[1] for t in block]] = _banded([t[2] for t in block], [t[3] for t in block], edits)
    return out


def _banded(longer: list[np.ndarray], shorter: list[np.ndarray], edits: int) -> np.ndarray:
    m, n = np.array([len(p) for p in longer]), np.array([len(q) for q in shorter])
    rows, width = len(longer), 2 * edits + 1
    full = np.uint64((1 << width) - 1)
    one, top = np.uint64(1), np.uint64(1 << (width - 1))
    nothing = np.uint32(0xFFFFFFFF)
    a = np.full((int(n.max()) + width + 1, rows), nothing, np.uint32)
    b = np.full((int(n.max()), rows), nothing - np.uint32(1), np.uint32)
    for k, (p, q) in enumerate(zip(longer, shorter)):
        take = min(len(p), len(a) - edits)
        a[edits : edits + take, k] = p[:take]
        b[: len(q), k] = q
    plus = np.full(rows, (1 << width) - (1 << (edits + 1)), np.uint64)
    minus = np.zeros(rows, np.uint64)
    diagonal = (edits + m - n).astype(np.uint64)
    value = (m - n).astype(np.int64)
    for j in range(len(b)):
        match = np.zeros(rows, np.uint64)
        for k in range(width):
            match |= (a[j + k] == b[j]).astype(np.uint64) << np.uint64(k)
        plus, minus = (plus >> one) | top, minus >> one
        if j < edits:  # rows above the first have no steps
            below = np.uint64(((1 << width) - 1) & ~((1 << (edits - j)) - 1))
            plus, minus, match = plus & below, minus & below, match & below
        same = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = (minus | ~(same | plus)) & full
        down = plus & same
        value += (j < n) & ~((same >> diagonal) & one).astype(bool)
        up, down = ((up << one) | one) & full, (down << one) & full
        plus, minus = (down | ~(same | up)) & full, same & up
    return value <= edits


def alike(left: list[str], right: list[str]) -> np.ndarray:
    """Which pairs of lines are within the edits ``allowed`` for the shorter one."""
    edits = allowed(np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64))
    out = np.array([x == y for x, y in zip(left, right)], bool)
    for k in range(1, EDITS + 1):
        at = np.flatnonzero(edits == k)
        out[at] = within([left[i] for i in at], [right[i] for i in at], k)
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "p"):
        near = alike(batch.column("p").to_pylist(), batch.column("q").to_pylist())
        yield batch.select(["x", "y"]).filter(pa.array(near))


def _block_links(root: np.ndarray, n: np.ndarray, parity: np.ndarray, side: np.ndarray, lines: list[str]) -> Iterator[tuple[int, int]]:
    """Places of alike lines, enough to join all alike lines of the block that were apart. Of a block of two sides only
    lines of different sides are compared."""
    both, root = bool(side.any() and not side.all()), root.copy()
    left, right = [], []
    for i in range(len(lines)):
        edits = allowed(np.minimum(n[i], n))
        may = (root != root[i]) & (np.abs(n - n[i]) <= edits) & (np.bitwise_count(parity ^ parity[i]) <= 2 * edits)
        may[:i] = False
        if both:
            may &= side != side[i]
        at = np.flatnonzero(may).tolist()
        left += [i] * len(at)
        right += at
        if len(left) >= BATCH_PAIRS or (left and i + 1 == len(lines)):  # few at a time: most of a group of alike lines is joined by then
            for k in np.flatnonzero(alike([lines[x] for x in left], [lines[y] for y in right])).tolist():
                x, y = left[k], right[k]
                if root[x] != root[y]:
                    yield x, y
                    root[root == root[y]] = root[x]
            left, right = [], []


def _small_links(blocks: list[list[tuple]]) -> list[tuple[int, int]]:
    """Nodes that ``_block_links`` would join in each of several small blocks, with all candidates verified in one step."""
    rows = [row for block in blocks for row in block]
    node, root, n, parity, side, lines = zip(*rows)
    size = np.array([len(block) for block in blocks])
    home = np.repeat(np.arange(len(blocks)), size)
    behind = np.cumsum(size)[home] - np.arange(len(rows))  # rows of the block from this one on
    root, n, parity, side = np.array(root), np.array(n), np.array(parity).view(np.uint64), np.array(side, bool)
    in_side = np.bincount(home, side, len(blocks))
    both = ((in_side > 0) & (in_side < size))[home]
    found = []
    for step in range(1, SMALL_BLOCK):
        i = np.flatnonzero(behind > step)
        j = i + step
        edits = allowed(np.minimum(n[i], n[j]))
        may = (root[i] != root[j]) & (np.abs(n[i] - n[j]) <= edits) & (np.bitwise_count(parity[i] ^ parity[j]) <= 2 * edits)
        may &= ~both[i] | (side[i] != side[j])
        found.append(np.stack([i[may], j[may]]))
    i, j = np.concatenate(found, axis=1)
    near = np.flatnonzero(alike([lines[k] for k in i], [lines[k] for k in j])) if len(i) else []
    joined, links = {}, []

    def top(key):
        while key in joined:
            key = joined[key]
        return key

    for x, y in zip(i[near].tolist(), j[near].tolist()) if len(near) else ():
        p, q = top((home[x], root[x])), top((home[y], root[y]))
        if p != q:
            joined[p] = q
            links.append((node[x], node[y]))
    return links


def _in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("node", "root", "n", "parity", "side", "line")

    def told(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], ["x", "y"])

    def large(rows: list[tuple]) -> pa.RecordBatch:
        node, root, n, parity, side, lines = zip(*rows)
        found = _block_links(np.array(root), np.array(n), np.array(parity).view(np.uint64), np.array(side), lines)
        return told([(node[i], node[j]) for i, j in found])

    now, rows, small, chars = None, [], [], 0
    for batch in batches:
        for block, row in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))), zip(*(batch.column(c).to_pylist() for c in names))):
            if block != now:
                if len(rows) > SMALL_BLOCK:
                    yield large(rows)
                elif len(rows) > 1:
                    small.append(rows)
                    chars += sum(len(r[5]) for r in rows)
                if chars > STEP_CHARS:
                    yield told(_small_links(small))
                    small, chars = [], 0
                now, rows = block, []
            rows.append(row)
    if len(rows) > SMALL_BLOCK:
        yield large(rows)
    elif len(rows) > 1:
        small.append(rows)
    if small:
        yield told(_small_links(small))


def near_lines(docs: DataFrame) -> DataFrame:
    """(a, b): hashes of lines, links that join all alike lines of ``docs(text)`` that are not equal into components.

    Keys are made once. They travel with their lines' hashes as packed numbers, many to a row, to the part of the key, where
    those that one line has alone are left out. Most alike lines are joined through leads; those still apart under a key are
    compared in blocks of bounded size, out of which only links come that join what was apart.
    """
    source = docs.select("text")
    dealt = source.mapInArrow(_keyed, "part int, known boolean, keys binary, nodes binary").repartition("part")
    met = dealt.sortWithinPartitions("part").mapInArrow(_shared, "key long, node long")
    met = write_once(met.distinct(), "met")
    texts = write_once(_line_texts(docs, write_once(met.select("node").distinct(), "wanted")), "line_texts")
    index = write_once(met.join(sized_broadcast(texts.select("node", F.struct("n", "parity").alias("about"))), "node"), "index")

    def check(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("x"), F.col("line").alias("p")), "x")
        both = both.join(texts.select(F.col("node").alias("y"), F.col("line").alias("q")), "y")
        return both.select("x", "y", "p", "q").mapInArrow(_verified, "x long, y long")

    none = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    links = lead_links(index, none, _may, check, "lines", LEADS_WORTH)
    rows, links = rooted(index, links, "rest")
    rows = write_once(rows.join(sized_broadcast(write_once(lists_apart(rows, list_parts()), "rest_lists")), "key"), "rest")
    rows = rows.join(texts.select("node", "line"), "node").select("key", "node", "parts", "root", "about.n", "about.parity", "line")
    found = in_blocks(rows, "node", "root", "n", "parity", "line").mapInArrow(_in_block, "x long, y long")
    return write_once(links.union(found), "near")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, totals, dropped = [], [], []
        for t, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            parts = [] if t is None else t.split("\n")
            out = set(gone or ())
            texts.append("\n".join(x for i, x in enumerate(parts) if i not in out) if out else t)
            totals.append(len(parts))
            dropped.append(len(out))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), batch.column("repeats_of")],
            ["row_", "text", "n_lines", "n_dropped", "repeats_of"],
        )


def _deduped(docs: DataFrame) -> DataFrame:
    rows = packed(docs).withColumn("tk", F.xxhash64("text"))
    places = write_once(rows.select("doc_id", "tk", "text").mapInArrow(_places, "doc_id long, tk long, line int, lh long"), "places")
    place = F.struct("doc_id", "tk", "line")
    firsts = write_once(places.groupBy("lh").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    roots = connected_components(near_lines(docs.select("text"))).withColumnsRenamed({"node": "lh"})
    known = firsts.join(roots, "lh", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "lh"))
    known = write_once(known, "classes")
    least = known.groupBy("root").agg(F.min("first").alias("class_first"))
    members = write_once(known.join(least, "root").select("lh", "class_first"), "members")
    met = places.join(members, "lh")
    later = ~place.eqNullSafe(F.col("class_first"))
    marks = met.filter(later).groupBy("doc_id", "tk").agg(
        F.collect_set("line").alias("gone"), F.sort_array(F.collect_set("class_first.doc_id")).alias("repeats_of")
    )
    marks = write_once(marks.withColumnsRenamed({"doc_id": "mark_id", "tk": "mark_tk"}), "marks")
    marked = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & F.col("tk").eqNullSafe(F.col("mark_tk")), "left")
    marked = marked.select("row_", "text", "gone", F.coalesce("repeats_of", F.array().cast("array<long>")).alias("repeats_of"))
    kept = [marked.schema["row_"], marked.schema["text"], StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    return marked.mapInArrow(_cut, StructType([*kept, marked.schema["repeats_of"]]))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, and with ``n_lines``, ``n_dropped`` and
    ``repeats_of`` (doc_ids that hold the first lines of the classes); these replace columns of the same name.

    Lines are compared without blanks at their ends. Two lines are alike if they are equal or within one edit for
    each ``CHARS_PER_EDIT`` code points of the shorter one, ``EDITS`` at most. Lines of one class are joined by a chain
    of alike lines; the first by (doc_id, place) stays. Empty lines always stay. Null ids come first; rows
    that repeat id and text are treated alike. Null texts stay null; a text may end up empty.
    """
    return unpacked(_deduped(docs), docs.columns, ("n_lines", "n_dropped", "repeats_of"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(table(spark, folder, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with shorter texts and their length in ``n_chars``."""
    cut = unpacked(_deduped(docs), docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


QUERIES = {"op8_line_dedup": (query, None)}
