"""Odd tables that every operator must take: null ids and texts, empty and long texts, repeated rows, ties,
extra columns named like the operators' own, and no rows at all."""

import pytest
from odd_tables import EXTRA, PASSAGE, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({name: F.lit(name) for name in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (5, 0, 1), (6, None, None), (None, 1, 0), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, PASSAGE.upper() + " indeed")], "item_id long, text string")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
