"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, weighted shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivertrace.llm.common import sized_broadcast, table
from rivertrace.session import write_once

WORDS = 5
THRESHOLD = 0.8
RADIUS = 15
NIBBLES = 16
RAREST = 8
LANE = 0x0000000100000001


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. A text that begins or ends with another sign has an empty word
    there, which no shingle of an item contains."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def with_shingles(texts: DataFrame, text: Column) -> DataFrame:
    """Adds ``hs``: 64-bit hashes of all runs of ``WORDS`` words in order, repeats included; none if there are
    fewer. The words of five shifted copies are zipped, so that they are cut from the text once."""
    cut = texts.withColumn("words_", words(text))
    n = F.size("words_") - WORDS + 1
    shifted = [F.slice("words_", F.lit(k + 1), F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(WORDS)]
    hashed = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(WORDS)]))
    return cut.withColumn("hs", hashed).drop("words_")


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, h, c, w): the distinct shingles of each item, how often it has them, and their weight:
    1 to ``RAREST``, one less for each doubling of the number of items that have the shingle. m counts
    all shingles of the item. Items of fewer than ``WORDS`` words have no row: such a phrase is no leak."""
    trimmed = F.regexp_replace("text", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    items = with_shingles(benchmark.select("item_id", "text"), trimmed)
    each = items.select("item_id", F.size("hs").alias("m"), F.explode("hs").alias("h")).groupBy("item_id", "m", "h").agg(F.count(F.lit(1)).alias("c"))
    df = each.groupBy("h").agg(F.count_distinct("item_id").alias("df"))
    weight = F.greatest(F.lit(1), RAREST - F.floor(F.log2("df"))).cast("long")
    return each.join(df, "h").select("item_id", "m", "h", "c", weight.alias("w"))


def anchors(items: DataFrame) -> DataFrame:
    """(h, m): for each item its weightiest shingles, as few as leave less than ``THRESHOLD`` of its weight.
    A window that reaches the threshold shares that much weight with the item, so it holds one of them."""
    order = Window.partitionBy("item_id", "m").orderBy(F.desc("w"), "h")
    before = F.coalesce(F.sum(F.col("c") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("c") * F.col("w")).over(Window.partitionBy("item_id", "m"))
    left = items.withColumns({"before": before, "total": total})
    return left.filter(F.col("total") - F.col("before") >= F.col("total") * THRESHOLD - 1e-9).select("h", "m").distinct()


def simhash(hash_: Column, weight: Column) -> tuple[list[Column], Column]:
    """Aggregates of a weighted SimHash: 32 sums, each holding the set bits i and i + 32 in its two halves,
    and the total weight."""
    sums = [F.sum(F.shiftright(hash_, i).bitwiseAND(F.lit(LANE)) * weight).alias(f"s{i}") for i in range(32)]
    return sums, F.sum(weight).alias("total")


def simhash_bits() -> Column:
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{i}", 32)
        for at, count in ((i, low), (i + 32, high)):
            bit = 1 << at if at < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("total"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return fp


def nibbles(fp: Column) -> Column:
    """The sixteen blocks of a fingerprint: two at most ``RADIUS`` = 15 bits apart agree in one of them."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftright(fp, 4 * i).bitwiseAND(F.lit(15)).alias("bits")) for i in range(NIBBLES)]))


def _prints(rows: DataFrame, by: list[str], hash_: Column, weight: Column) -> DataFrame:
    sums, total = simhash(hash_, weight)
    return rows.groupBy(*by).agg(*sums, total).select(*by, "total", simhash_bits().alias("fp"))


def _numbered(hs: str) -> Column:
    """Each shingle with its number among equal ones, from 1."""
    plain = F.transform(hs, lambda h: F.struct(h.alias("h"), F.lit(1).alias("nth")))
    counted = F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.size(F.filter(F.slice(hs, F.lit(1), i + 1), lambda x: x == h)).alias("nth")))
    return F.when(F.size(F.array_distinct(hs)) == F.size(hs), plain).otherwise(counted)


def text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(text)


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, start, m, hs): the windows of m shingles that hold an anchor of an item with m shingles.

    Equal texts stand as one (``key``). Every word of every text is looked at; only where an anchor is met
    are windows laid, at each start that takes it in. A text shorter than the item is one window.
    """
    sized = sized_broadcast(write_once(anchors(items), "anchors"))
    each = with_shingles(docs.select(text_key().alias("key"), "text"), F.col("text"))
    # Outer: for the inner form Spark would cut every text a second time to filter those without shingles.
    met = each.select("key", "hs", F.size("hs").alias("n")).select("key", "n", F.posexplode_outer("hs").alias("at", "h")).join(sized, "h")
    met = met.select("key", "n", "m", "at").distinct()
    starts = F.sequence(F.greatest(F.lit(0), F.least(F.col("at") - F.col("m") + 1, F.col("n") - F.col("m"))), F.greatest(F.lit(0), F.least("at", F.col("n") - F.col("m"))))
    places = write_once(met.select("key", "m", F.explode(starts).alias("start")).distinct(), "places")
    keys = sized_broadcast(write_once(places.select("key").distinct(), "keys"))
    texts = docs.select("text", text_key().alias("key")).join(keys, "key", "left_semi").dropDuplicates(["key"])
    whole = with_shingles(texts, F.col("text")).select("key", "hs")
    cut = F.slice("hs", F.col("start") + 1, F.col("m"))
    return places.join(whole, "key").select("key", "start", "m", cut.alias("hs"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id, start, hamming, similarity): the best window of every distinct text for every item it
    leaks; ``key`` is ``text_key`` of the text.

    Windows and items of one size are joined on the blocks of their fingerprints, which meets every pair
    within ``RADIUS`` bits; those pairs are verified by the weighted Jaccard similarity of their shingles,
    repeats included, which must reach ``threshold``. Ties of windows go to the first.
    """
    items = write_once(item_shingles(benchmark), "items")
    laid = write_once(windows(docs, items), "windows")
    weights = sized_broadcast(write_once(items.select("h", "w").distinct(), "weights"))
    weight = F.coalesce("w", F.lit(RAREST))
    # A window's rows come from one row, so its sums are complete before the shuffle.
    each = laid.select("key", "start", "m", F.explode_outer("hs").alias("h")).join(weights, "h", "left")
    window_fp = write_once(_prints(each, ["key", "start", "m"], F.col("h"), weight), "prints")
    item_fp = _prints(items, ["item_id", "m"], F.col("h"), F.col("c") * F.col("w"))
    a = window_fp.select("*", nibbles(F.col("fp")).alias("x")).select("key", "start", "m", "fp", F.col("total").alias("ta"), "x.*")
    b = item_fp.select("*", nibbles(F.col("fp")).alias("x")).select("item_id", "m", F.col("fp").alias("item_fp"), F.col("total").alias("tb"), "x.*")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = a.join(b, ["m", "block", "bits"]).withColumn("hamming", apart).filter(F.col("hamming") <= RADIUS)
    near = near.select("key", "start", "m", "item_id", "hamming", "ta", "tb").distinct()
    held = near.join(laid.select("key", "start", "m", _numbered("hs").alias("hs")), ["key", "start", "m"])
    met = held.select("key", "item_id", "start", "hamming", "ta", "tb", F.explode_outer("hs").alias("x")).select("*", "x.h", "x.nth").drop("x")
    shared = (
        met.join(sized_broadcast(items.select("item_id", "h", "c", "w")), ["item_id", "h"]).filter("nth <= c")
        .groupBy("key", "item_id", "start", "hamming", "ta", "tb").agg(F.sum("w").alias("both"))
    )
    scored = shared.withColumn("similarity", F.col("both") / (F.col("ta") + F.col("tb") - F.col("both"))).filter(F.col("similarity") >= threshold)
    best = scored.groupBy("key", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "hamming")).alias("x"))
    return write_once(best.select("key", "item_id", (-F.col("x.col2")).cast("long").alias("start"), F.col("x.hamming").cast("int").alias("hamming"), "x.similarity"), "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, hamming, similarity) for every row and item that leaks into it; start counts
    words. Null and empty texts leak nothing; rows without an id are reported with a null id."""
    found = leaks(docs, benchmark, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    return rows.join(sized_broadcast(found), "key").select("doc_id", "item_id", "start", "hamming", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    keys = leaks(docs, benchmark, threshold).select(F.col("key").alias("leak_key_")).distinct()
    bad = sized_broadcast(write_once(keys, "leaking"))
    return docs.join(bad, text_key(docs["text"]) == bad["leak_key_"], "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return clean(docs, table(spark, folder, "benchmark"))


QUERIES = {"op3_decontamination": (query, None)}
