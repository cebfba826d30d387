"""Substring dedup by sliding sentence spans: sentences inside a run seen earlier anywhere are removed."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rivertrace.llm.common import packed, pieces, table, unpacked
from rivertrace.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = 2
RUN_WORDS = 12
LONGEST = 16
CUT_ONE_IN = 12
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of a text, which tile it; a stretch without words belongs to the
    sentence before it.

    A sentence of more than ``LONGEST`` words is cut after words picked by their hash, at the latest after
    ``LONGEST``, so that two copies of a passage are cut alike wherever their sentence began.
    """
    found: list[tuple[int, int, list[str]]] = []
    for m in SENTENCE.finditer(text):
        start, end = m.span()
        words = WORD.findall(m.group().lower())
        if not words:
            if found:
                found[-1] = (found[-1][0], end, found[-1][2])
            continue
        if len(words) <= LONGEST:
            found.append((start, end, words))
            continue
        part: list[str] = []
        for w in WORD.finditer(text, start, end):
            part.append(w.group().lower())
            if len(part) == LONGEST or not zlib.crc32(part[-1].encode()) % CUT_ONE_IN:
                found.append((start, w.end(), part))
                start, part = w.end(), []
        if part:
            found.append((start, end, part))
        else:
            found[-1] = (found[-1][0], end, found[-1][2])
    if found:
        found[0] = (0, found[0][1], found[0][2])
    return found


def _shortest(counts: list[int]) -> Iterator[tuple[int, int]]:
    """(first sentence, end) of the shortest run from each sentence on that has ``RUN`` sentences and
    ``RUN_WORDS`` words; none where the text ends before."""
    end, words = 0, 0
    for i in range(len(counts)):
        while end < len(counts) and (words < RUN_WORDS or end - i < RUN):
            words += counts[end]
            end += 1
        if words < RUN_WORDS or end - i < RUN:
            return
        yield i, end
        words -= counts[i]


def runs(parts: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int, int]]:
    """(first sentence, sentences, hash) of the shortest runs of ``RUN`` sentences and ``RUN_WORDS`` words that
    start at each sentence, and of those that end at each, in order of place; each run once.

    Of a longer run every sentence lies in one of these that the run holds: in the one that starts there, or,
    where too little of the run is left, in the one that ends with it. So all runs are found by them.
    """
    joined = [" ".join(p[2]) for p in parts]
    counts = [len(p[2]) for p in parts]
    ending = ((len(counts) - end, len(counts) - i) for i, end in _shortest(counts[::-1]))
    for i, end in sorted({*_shortest(counts), *ending}):
        yield i, end - i, xxhash.xxh64_intdigest(" ".join(joined[i:end])) - (1 << 63)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        index, at, length, value = [], [], [], []
        for k, t in enumerate(batch.column("text").to_pylist()):
            for i, n, h in runs(sentences(t or "")):
                index.append(k)
                at.append(i)
                length.append(n)
                value.append(h)
        rows = pa.array(index, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("tk").take(rows), pa.array(at, pa.int32()), pa.array(length, pa.int32()), pa.array(value, pa.int64())],
            ["doc_id", "tk", "at", "n", "h"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, removed = [], []
        for t, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            gone = {i for m in marks or () for i in range(m["at"], m["at"] + m["n"])}
            texts.append(t if not gone else "".join(t[s:e] for i, (s, e, _) in enumerate(sentences(t)) if i not in gone))
            removed.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), batch.column("repeats_of")],
            ["row_", "text", "n_removed", "repeats_of"],
        )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed sentences cut from ``text``, and with ``n_removed`` and ``repeats_of`` (the
    doc_ids that hold the first copies of what was removed); these replace columns of the same name.

    The first copy of a run is the one with the smallest (doc_id, place); null ids come first. Rows that
    repeat both id and text are one document and are treated alike. Null texts stay null, empty ones empty,
    and a text shorter than a run is never touched. A run repeated inside one text is a repetition, too.

    Only hashes that occur twice go further than their count. Runs are counted before the shuffle, so a
    passage in a third of all documents is one row per task there; joins on it are split by Spark.
    """
    rows = packed(docs).withColumn("tk", F.xxhash64("text"))
    spans = write_once(rows.select("doc_id", "tk", "text").mapInArrow(_spans, "doc_id long, tk long, at int, n int, h long"), "spans")
    again = write_once(spans.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("h"), "repeated")
    copies = write_once(spans.join(again, "h"), "copies")
    place = F.struct("doc_id", "tk", "at")
    # A table of its own, so that the join deals both sides out and Spark can split a hot passage.
    first = write_once(copies.groupBy("h").agg(F.min(place).alias("first")), "firsts")
    later = copies.join(first, "h").filter(~place.eqNullSafe(F.col("first")))
    marks = later.groupBy("doc_id", "tk").agg(
        F.collect_set(F.struct("at", "n")).alias("marks"), F.sort_array(F.collect_set("first.doc_id")).alias("repeats_of")
    )
    marks = write_once(marks.withColumnsRenamed({"doc_id": "mark_id", "tk": "mark_tk"}), "marks")
    marked = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & F.col("tk").eqNullSafe(F.col("mark_tk")), "left")
    marked = marked.select("row_", "text", "marks", F.coalesce("repeats_of", F.array().cast("array<long>")).alias("repeats_of"))
    schema = StructType([marked.schema["row_"], marked.schema["text"], StructField("n_removed", LongType()), marked.schema["repeats_of"]])
    return unpacked(marked.mapInArrow(_cut, schema), docs.columns, ("n_removed", "repeats_of"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op10_span_dedup": (query, None)}
