"""URL filter: rules by host and path, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import table
from rivertrace.session import cut_lineage

#: The rules of the production filter.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LABELLED_URLS = 20_000
TREES, DEPTH = 10, 3
SMOOTHING = 20.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "suffix_rate", "domain_rate")


def host(url: str = "url") -> Column:
    """Between the first ``://`` and the next slash, question mark or hash, A-Z lower-cased; empty without."""
    found = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruling(rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits ``host`` and ``path``, else null. Of two rules of
    one text, block wins."""
    fitting = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.greatest(*fitting, F.lit(None)) if fitting else F.lit(None).cast("struct<n:int,verdict:string,rule:string>")


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    terms = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"),
    )
    return F.log2(n.cast("double")) - F.aggregate(F.filter(terms, lambda k: k > 0), F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n


def lexical(urls: DataFrame) -> DataFrame:
    """Adds what is read off the url itself; a null url counts as empty."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    def count(text, pattern):
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return urls.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "labels": F.size(F.split("host", "\\.")).cast("double"),
        "digits": count(url, "[0-9]") / n,
        "hyphens": count(F.col("host"), "-").cast("double"),
        "entropy": entropy(url),
        "parameters": F.when(F.contains(url, F.lit("?")), 1 + count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")).otherwise(0).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
    })


def labelled(urls: DataFrame, labels: DataFrame, limit: int = LABELLED_URLS) -> DataFrame:
    """(url parts and features, bad): a sample bounded by ``limit``, chosen by a hash of the id. A page is
    bad if its document is labelled of low quality or toxic; of contradicting labels the bad one counts."""
    bad = F.max(F.greatest(1 - F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0)))).cast("double")
    marks = labels.filter("doc_id is not null and coalesce(quality, toxic) is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    # The ids are drawn before anything is computed from the urls.
    drawn = urls.select("page_id", "host", "path", "url").join(marks, "page_id").orderBy(F.xxhash64("page_id"), "page_id", "url").limit(limit)
    return cut_lineage(lexical(drawn))


def _rates(sample: DataFrame, key: str, prior: float) -> DataFrame:
    return sample.groupBy(key).agg(F.sum("bad").alias(f"{key}_bad"), F.count(F.lit(1)).alias(f"{key}_n"))


def with_rates(urls: DataFrame, sample: DataFrame, prior: float, own: Column) -> DataFrame:
    """Adds the smoothed share of bad urls per suffix and per domain. ``own`` is the row's own mark (null
    outside the sample): it is taken out, so a labelled url does not see its own answer. The tables hold
    no more rows than the sample, whose size is bounded, and are broadcast."""
    known = F.when(own.isNotNull(), 1).otherwise(0)
    for key in ("suffix", "domain"):
        rates = F.broadcast(_rates(sample, key, prior))
        bad = F.coalesce(f"{key}_bad", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
        seen = F.coalesce(f"{key}_n", F.lit(0)) - known
        urls = urls.join(rates, key, "left").withColumn(f"{key}_rate", (bad + SMOOTHING * prior) / (seen + SMOOTHING))
    return urls


def badness(urls: DataFrame, labels: DataFrame, limit: int = LABELLED_URLS) -> DataFrame:
    """Adds ``badness``, the trees' probability that a url is bad. Without both kinds of labelled urls there
    is nothing to learn and it is 0."""
    sample = labelled(urls, labels, limit)
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    if bad in (0.0, float(n)):
        return urls.withColumn("badness", F.lit(0.0))
    prior = bad / n
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features_")
    trees = GBTClassifier(featuresCol="features_", labelCol="bad", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = trees.fit(vectors.transform(with_rates(sample, sample, prior, F.col("bad"))).select("features_", "bad"))
    judged = model.transform(vectors.transform(with_rates(lexical(urls), sample, prior, F.lit(None).cast("double"))))
    return judged.withColumn("badness", vector_to_array("probability")[1]).select(*urls.columns, "badness")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: int = LABELLED_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, badness) for every row: the longest fitting rule decides, else
    the trees (block from one half on). A null url, or one without ``://``, has empty parts and is judged
    by the trees. Other columns of ``pages`` are not read."""
    urls = pages.select("page_id", "url", host().alias("host"), path().alias("path"))
    rated = badness(urls, labels, limit).withColumn("ruling_", ruling(rules))
    verdict = F.coalesce(F.col("ruling_.verdict"), F.when(F.col("badness") >= 0.5, "block").otherwise("allow"))
    return rated.select("page_id", "host", "path", F.col("ruling_.rule").alias("rule"), verdict.alias("verdict"), "badness")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


QUERIES = {"op1_url_filter": (query, None)}
