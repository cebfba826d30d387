"""SpotSigs fingerprints: chains of content words after common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivertrace.llm.common import connected_components, sized_broadcast, table
from rivertrace.session import write_once

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the of and to a in is that for it was with on by as be this are at from "
    "de la le et les des en un du une que est pour par qui dans pas sur au "
    "der die und den von zu das mit sich auf ist nicht im dem ein eine als "
    "el y los se las del con por no su una para es al lo"
).split()
MARK = "\x01"
THRESHOLD = 0.8
STRETCH = 120
BIN_ROWS = 1 << 16


def _branch(words: list[str]) -> str:
    """A pattern of the given words by their first letters, so that a word is tried letter by letter and not
    against each of them."""
    if not words:
        return ""
    heads = sorted({w[0] for w in words if w})
    tails = [h + _branch(sorted(w[1:] for w in words if w[:1] == h)) for h in heads]
    one = tails[0] if len(tails) == 1 and "" not in words else f"(?:{'|'.join(tails)})" if tails else ""
    return f"{one}?" if "" in words and one else one


def _anchored(text: Column) -> Column:
    """Lower-case words between single spaces; an anchor hangs on the word before it behind a mark, so that
    content words stay one space apart. Of a run of anchors the last is left."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.regexp_replace(words, rf" ({_branch(sorted(set(ANCHORS)))})(?= )", MARK + "$1")
    return F.regexp_replace(marked, rf"{MARK}[^ {MARK}]+(?={MARK})", "")


def _pairs(words: Column) -> Column:
    return F.transform(F.regexp_extract_all(words, F.lit(r"(?= ([^ ]+(?: [^ ]+)?) )"), 1), lambda s: F.hash(s))


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted set of 32-bit hashes of (anchor, content word, next content word) as ``name``.

    Stretches of more than ``STRETCH`` characters without an anchor (tables, lists, other languages) add
    each pair of neighbouring words, and so does a text that has no signature otherwise; a single word
    stands by itself. Null and empty texts have the empty set. Steps are columns of their own, so that Spark
    takes each once.
    """
    chains = F.regexp_extract_all("anchored_", F.lit(rf"(?={MARK}([^ {MARK}]+ [^ {MARK}]+(?:(?:{MARK}[^ ]+)? [^ {MARK}]+)?))"), 1)
    spots = F.transform(chains, lambda s: F.hash(F.when(F.contains(s, F.lit(MARK)), F.regexp_replace(s, rf"{MARK}[^ ]+", "")).otherwise(s)))
    bare = F.filter(F.split("anchored_", MARK), lambda s: F.length(s) > STRETCH)
    stretches = F.flatten(F.transform(bare, lambda s: _pairs(F.concat(F.lit(" "), s, F.lit(" ")))))
    plain = F.when(F.size("found_") > 0, F.col("found_")).otherwise(_pairs(F.translate("anchored_", MARK, " ")))
    return (
        rows.withColumn("anchored_", _anchored(F.coalesce(text, F.lit(""))))
        .withColumn("found_", F.concat(spots, stretches))
        .withColumn(name, F.sort_array(F.array_distinct(plain)))
        .drop("anchored_", "found_")
    )


def fingerprint(signature: Column) -> Column:
    return F.array_join(signature.cast("array<string>"), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; sets whose lengths alone rule out ``least`` are not compared and get
    0. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < F.lit(least) * large), 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def _bins(docs: DataFrame) -> tuple[int, int]:
    """Least id and width of the id bins in which neighbours are found."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if low is None:
        return 0, 1
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return low, max(1, math.ceil((high - low + 1) / max(4 * tasks, n // BIN_ROWS)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs) for every row; the next row is that of the next smaller
    doc_id, and after the last the first. Rows that repeat an id follow each other by text; rows without
    an id come last.

    Rows are laid in bins of the id, and the first row of each bin is copied to the bin before it, so one
    shuffle carries the texts and no task orders the whole table. The bin heads are one row per bin.
    """
    low, width = _bins(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("bin", F.floor((F.col("key") - (low - 1)) / width))
    heads = rows.groupBy("bin").agg(F.max("key").alias("head"))
    order = Window.orderBy("bin")
    before = F.coalesce(F.lead("bin").over(order), F.first("bin").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    copies = write_once(heads.withColumn("to", before).select("head", "to"), "heads")
    both = rows.join(sized_broadcast(copies), F.col("key") == F.col("head"), "left").select(
        "doc_id", "text", "key",
        F.explode(F.filter(F.array(F.struct(F.col("bin"), F.lit(0).alias("copy")), F.struct(F.col("to").alias("bin"), F.lit(1).alias("copy"))), lambda x: x.bin.isNotNull())).alias("at"),
    ).select("doc_id", "text", "key", "at.bin", "at.copy")
    signed = with_signatures(both.repartition("bin"), "text", "sigs")
    inside = Window.partitionBy("bin").orderBy("copy", F.desc("key"), "text")
    return (
        signed.withColumn("next", F.lead(F.struct("text", "sigs")).over(inside)).filter("copy = 0")
        .select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))
    )


def with_edit(docs: DataFrame) -> DataFrame:
    """Adds to ``with_next`` the edited text: its last third replaced by the opening of the next text."""
    third = F.floor(F.length("text") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - third)
    edited = with_next(docs).withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    return with_signatures(edited, "edited", "edited_sigs")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): class_id is the smallest doc_id reachable over links of Jaccard similarity
    ``threshold`` or more, links the number of other sets linked to this one.

    Documents with one set of signatures are one node. Sets are partitioned by length on a geometric scale,
    so that a link joins equal or neighbouring partitions only, and indexed there by as many of their rarest
    signatures as a link must share one of; sizes are compared before sets are. Null doc_ids have no class.
    """
    rows = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "sigs")
    signed = write_once(rows.drop("text"), "signed")
    nodes = signed.groupBy("sigs").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("sigs"))
    nodes = write_once(nodes.withColumn("n", F.size("sigs")), "sets")
    each = nodes.filter("n > 0").select("node", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    ranked = each.join(rarity, "sig").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    index = ranked.select("node", "n", part.alias("part"), F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("x")).select("node", "n", "part", "x.sig")
    index = write_once(index, "index")
    probe = index.withColumn("part", F.explode(F.array("part", F.col("part") - 1)))
    a, b = index.alias("a"), probe.alias("b")
    likely = (
        (F.col("a.part") == F.col("b.part")) & (F.col("a.sig") == F.col("b.sig"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))))
        & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
    )
    pairs = a.join(b, likely).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    sets = nodes.select("node", "sigs")
    checked = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("sigs").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("sigs").alias("y")), "b")
        .filter(likeness(F.col("x"), F.col("y"), threshold) >= threshold).select("a", "b")
    )
    links = write_once(checked, "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    member = nodes.drop("sigs").join(connected_components(links), "node", "left").join(degree, "node", "left")
    least = member.groupBy(F.coalesce("root", "node").alias("root_")).agg(F.min("first").alias("class_id"))
    classes = member.withColumn("root_", F.coalesce("root", "node")).join(least, "root_").select("node", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return signed.select("doc_id", F.xxhash64("sigs").alias("node")).join(classes, "node").select("doc_id", "class_id", "links")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return with_edit(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


QUERIES = {"op7_spotsigs": (query, None)}
