"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivertrace.llm import byte_bpe, decontamination, line_dedup, quality, simhash_dedup
from rivertrace.llm.common import table
from rivertrace.session import write_once

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontamination", decontamination.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: SQL cannot express the fitted sampling, the edit join or the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and text of every document that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return docs
