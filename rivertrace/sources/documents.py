"""Readers of the network document and the industry profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace import schemas

TABLES = ("nodes", "edges", "stations", "enterprises", "fingerprints")


def read_network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of a network document (one nested JSON object)."""
    document = spark.read.schema(schemas.NETWORK_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    return {name: document.select(F.inline(name)) for name in TABLES}


def read_industry_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(industry, label, peaks, outfall_conc); entries without a label (remarks) are left out."""
    text = spark.read.text(path, wholetext=True)
    profiles = F.from_json("value", f"map<string, struct<{_struct(schemas.INDUSTRY_PROFILE)}>>")
    return (
        text.select(F.explode(profiles).alias("industry", "p"))
        .where("p.label IS NOT NULL")
        .select("industry", "p.label", "p.peaks", "p.outfall_conc")
    )


def _struct(ddl: str) -> str:
    """Column list to struct fields: the space after each top-level name becomes a colon."""
    depth, fields, current = 0, [], ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            fields.append(current)
            current = ""
        else:
            current += ch
    fields.append(current)
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields)


def from_text_columns(raw: DataFrame, **columns: str) -> DataFrame:
    """Turns JSON text columns into nested ones, e.g. ``indicators="array<string>"``."""
    for name, kind in columns.items():
        raw = raw.withColumn(name, F.from_json(name, kind))
    return raw
