"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rivertrace.llm.common import packed, pieces, table, unpacked
from rivertrace.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 18
TARGET_DOCS = 40_000
PRIOR = 4.0
CALIBRATION_FOLDS = 4
LOSS = 0.005
SHARPNESS = 100.0
NOTHING = -50.0
SEED = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")


def grams(text: str | None) -> np.ndarray:
    """Buckets of all words and signs of a text, then of all pairs of neighbours; the two do not mix."""
    tokens = TOKEN.findall(text or "")
    one = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    single = (one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    return np.concatenate([single, two % np.uint64(BUCKETS) + np.uint64(BUCKETS)]).astype(np.int64)


def labelled_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good, harmless documents: those the target model learns from, and those that set the floor.
    A sample bounded by ``limit``, chosen by a hash of the id. Contradicting labels count as bad."""
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = one.filter("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"))
    ids, fold = _collected(good.orderBy("h", "doc_id").limit(limit))
    return np.sort(ids[fold != 0]), np.sort(ids[fold == 0])


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and calibration fold of ``rows(doc_id, h)``, as Arrow: row objects would take the driver ten times the room."""
    found = rows.toArrow()
    return found.column("doc_id").to_numpy(), found.column("h").to_numpy() % CALIBRATION_FOLDS


def toxic_ids(labels: DataFrame, limit: int = TARGET_DOCS) -> np.ndarray:
    """Ids of the documents labelled toxic that the toxic model learns from; those left out are the same share
    as in ``labelled_ids`` and serve to test it."""
    toxic = labels.filter("doc_id is not null and toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h")).distinct()
    ids, fold = _collected(toxic.orderBy("h", "doc_id").limit(limit))
    return np.sort(ids[fold != 0])


def _member(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
    return wanted[at] == ids


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pa.compute.fill_null(batch.column("doc_id"), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _counter(target: np.ndarray, toxic: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The slot behind the buckets counts documents.
        raw, good, fine, harm = (np.zeros(2 * BUCKETS + 1, np.int64) for _ in range(4))
        for batch in pieces(batches):
            ids = _ids(batch)
            found = [grams(t) for t in batch.column("text").to_pylist()]
            raw += np.bincount(np.concatenate(found), minlength=len(raw))
            raw[-1] += len(found)
            for g, chosen, bad in zip(found, _member(ids, target).tolist(), _member(ids, toxic).tolist()):
                if chosen:
                    np.add.at(good, g, 1)
                if chosen or bad:
                    into = fine if chosen else harm
                    into[np.unique(g)] += 1
                    into[-1] += 1
        at = np.flatnonzero(raw)
        columns = {"bucket": at.astype(np.int32), "raw": raw[at], "good": good[at], "fine": fine[at], "harm": harm[at]}
        yield pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})

    return run


def log_ratios(docs: DataFrame, target: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p_target / p_raw and log p_toxic / p_target per bucket. Raw counts cover every gram of every
    document; each task sends one row per bucket it met. The target model backs off to the raw one, and the
    toxic to the target, with the weight of ``PRIOR`` expected grams, so a bucket they have hardly been able to
    show says nothing. The toxic model counts a gram once a document: a text that says one word many times
    does not make it a toxic one."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = source.mapInArrow(_counter(target, toxic), "bucket int, raw long, good long, fine long, harm long")
    columns = ("raw", "good", "fine", "harm")
    totals = counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    at = totals.column("bucket").to_numpy()
    raw, good, fine, harm = (totals.column(c).to_numpy() for c in columns)
    ratios, harms = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    if not good.sum():
        return ratios, harms
    size = at == 2 * BUCKETS
    rate = harm[size].sum() / max(1, fine[size].sum())
    for part in (at < BUCKETS, (at >= BUCKETS) & (at < 2 * BUCKETS)):
        expected = raw[part] * (good[part].sum() / max(1, raw[part].sum()))
        ratios[at[part]] = np.log((good[part] + PRIOR) / (expected + PRIOR))
        harms[at[part]] = np.log((harm[part] + PRIOR) / (fine[part] * rate + PRIOR))
    return ratios, harms


def _scorer(ratios, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, harms = ratios.value
        for batch in pieces(batches):
            scores, worst = [], []
            for t in batch.column("text").to_pylist():
                g = grams(t)
                scores.append(float(values[g].mean()) if len(g) else NOTHING)
                worst.append(float(harms[g].max()) if len(g) else 0.0)
            columns = [*(batch.column(n) for n in names), pa.array(scores, pa.float64()), pa.array(worst, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "log_ratio", "worst"])

    return run


def _kth(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column ``key``, by four counts over 16 bits each."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        level = keys if prefix is None else keys.filter(F.shiftright("key", shift + 16) == prefix)
        counts = {r.b: r["count"] for r in level.groupBy(F.shiftright("key", shift).alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            if left <= counts[b]:
                prefix = b
                break
            left -= counts[b]
    return prefix


def _drawn(docs: DataFrame, labels: DataFrame, loss: float, seed: int, whole: bool) -> DataFrame:
    fit, held = labelled_ids(labels)
    ratios = docs.sparkSession.sparkContext.broadcast(tuple(r.astype(np.float32) for r in log_ratios(docs, fit, toxic_ids(labels))))
    noise = -F.log(-F.log((F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    source = packed(docs).withColumn("noise", noise)
    names = ["row_", "doc_id", "text", "noise"] if whole else ["row_", "doc_id", "noise"]
    schema = StructType([*(source.schema[n] for n in names), StructField("log_ratio", DoubleType()), StructField("worst", DoubleType())])
    scored = source.mapInArrow(_scorer(ratios, names), schema).withColumn("gumbel_key", F.col("log_ratio") * SHARPNESS + F.col("noise"))
    scored = write_once(scored, "scored")
    reference = scored.join(docs.sparkSession.createDataFrame([(int(i),) for i in held], "doc_id long"), "doc_id", "left_semi")
    limits = (F.percentile("log_ratio", F.lit(loss)), F.percentile("worst", F.lit(1 - loss)))
    floor, ceiling = reference.agg(*limits).first() if len(fit) else (None, None)
    if floor is None:
        return scored
    scored = scored.filter(F.col("worst") <= ceiling)
    k = scored.filter(F.col("log_ratio") >= floor).count()
    order = F.round(F.col("gumbel_key") * 1e9).cast("long")
    return scored.filter(order >= _kth(scored.select(order.alias("key")), k))


def sample(docs: DataFrame, labels: DataFrame, loss: float = LOSS, seed: int = SEED) -> DataFrame:
    """The documents of a Gumbel top-k draw, with ``log_ratio`` and ``gumbel_key``, which replace columns of
    the same name.

    A document's weight is the mean log ratio of its grams (the ratio of the two models, per gram, so that
    long texts are not favoured) times ``SHARPNESS``; noise comes from a hash of its id and text, so a
    recomputed task draws the same. k is the number of documents not below the floor that all but ``loss`` of
    held-out good documents reach. A document whose most toxic word or pair of words (by the ratio of toxic to
    good text) is beyond what all but ``loss`` of the held-out good documents have goes before the draw, however
    little of its text that is. Documents with equal keys go together. A null or empty text, or one
    without words or signs, weighs ``NOTHING`` and goes, unless there are no labelled good documents to
    learn from and to set the floor: then there is no target and everything stays.
    """
    return unpacked(_drawn(docs, labels, loss, seed, True), docs.columns, ("log_ratio", "gumbel_key"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return _drawn(docs, table(spark, folder, "labels"), LOSS, SEED, False).select("doc_id", "log_ratio", "gumbel_key")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return unpacked(_drawn(docs, table(spark, folder, "labels"), LOSS, SEED, True), docs.columns)


QUERIES = {"op2_quality": (query, None)}
