"""The registry: every query has SQL beside it, and a sample of both agrees on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "nation supplier orders lineitem events documents embeddings conversations customer".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")


def test_every_query_has_sql():
    assert set(registry.OWN) == set(registry.oracle_sql()) & set(registry.OWN)


@pytest.mark.parametrize("name", ["impact_matrix", "hypotheses", "cusum_alarms", "event_contrast", "log_latest", "station_mix"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(row[c] for c in columns) for row in got.collect())
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert columns == sorted(names) and len(rows) == len(expected)
    for a, b in zip(rows, expected):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_entry(spark):
    assert registry.entry(spark).count() == 1500
