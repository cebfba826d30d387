"""Readers and stores on files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivertrace import schemas
from rivertrace.operators import casefile as K
from rivertrace.operators.readmodels import upsert_readings
from rivertrace.session import cut_lineage, shared_root
from rivertrace.sources import documents as D
from rivertrace.sources import stores as S

START = datetime(2024, 3, 1)
NETWORK = {
    "nodes": [{"id": "m0", "name": "head", "kind": "source", "x": 0.0, "y": 1.0, "flow": 71.0, "velocity": 0.9, "k": 0.31},
              {"id": "m1", "name": "mouth", "kind": "outlet", "x": 6.0, "y": 1.0, "flow": 88.0, "velocity": 0.9, "k": 0.31}],
    "edges": [{"from_node": "m0", "to_node": "m1", "distance_m": 7450.0}],
    "stations": [{"id": "st", "node_id": "m1", "interval_min": 15, "indicators": ["cod", "ph"]}],
    "enterprises": [{"id": "e", "name": "E", "industry": "food", "node_id": "m0",
                     "discharge_pattern": {"continuous": True, "active_hours": [0, 24], "q_waste": 0.01}}],
    "fingerprints": [{"enterprise_id": "e", "spectrum": [{"lex": 233, "lem": 517, "amp": 0.35, "sigma": 11}], "pollutants": {"cod": 1.0}}],
}


def test_network_document(spark, tmp_path):
    path = tmp_path / "network.json"
    path.write_text(json.dumps(NETWORK, indent=1), encoding="utf-8")
    tables = D.read_network(spark, str(path))
    assert {name: df.count() for name, df in tables.items()} == {"nodes": 2, "edges": 1, "stations": 1, "enterprises": 1, "fingerprints": 1}
    assert tables["enterprises"].first()["discharge_pattern"]["active_hours"] == [0, 24]
    assert tables["fingerprints"].first()["spectrum"][0]["lem"] == 517.0
    assert schemas.invalid_rows(tables["nodes"], {"kind": schemas.NODE_KINDS}).count() == 0
    S.reload_tables(tables, str(tmp_path / "db"))
    S.reload_tables(tables, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db" / "nodes")).count() == 2


def test_industry_profiles(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps({"meta": {"note": "n"}, "food": {"label": "F", "peaks": NETWORK["fingerprints"][0]["spectrum"],
                                                             "outfall_conc": {"cod": 413, "ph": -0.7}}}), encoding="utf-8")
    rows = D.read_industry_profiles(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["outfall_conc"] == {"cod": 413.0, "ph": -0.7} and rows[0]["peaks"][0]["sigma"] == 11.0


def test_readings_store(spark, tmp_path):
    path = str(tmp_path / "readings")
    rows = [("s", START + timedelta(hours=i), "cod", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, schemas.READINGS)
    S.write_readings(df, path)
    S.replace_dates(df.where("ts < '2024-03-02'").withColumn("value", F.lit(-1.0)), path)
    back = S.read_readings(spark, path)
    assert back.count() == 60 and back.where("value = -1").count() == 24
    plan = back.where("date = '2024-03-02' AND station_id = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(station_id,s)" in plan
    old = df.withColumn("version", F.lit(1))
    new = df.where("value < 10").withColumn("value", F.lit(99.0)).withColumn("version", F.lit(2))
    assert upsert_readings(old, new).where("value = 99").count() == 10


def test_message_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert S.read_messages(spark, path).count() == 0
    log = spark.createDataFrame([("b", 1, START, "step", "{}"), ("a", 2, START, "step", "x"), ("a", 1, START, "failed", "y")], schemas.MESSAGE)
    S.append_messages(log, path)
    (tmp_path / "log" / "inv_id=a" / "blank.json").write_text("\n  \n", encoding="utf-8")
    assert [r["seq"] for r in S.replay(spark, path, "a").collect()] == [1, 2]
    assert [r["inv_id"] for r in S.recordings(S.read_messages(spark, path)).collect()] == ["a", "b"]
    S.append_messages(log.limit(1).withColumn("inv_id", F.lit("007")), path)
    assert S.replay(spark, path, "007").count() == 1 and S.replay(spark, path, "7").count() == 0


def test_reports_and_status(spark, tmp_path):
    lines = spark.createDataFrame([("i", 0, 0.0, 0, 0, "# t"), ("i", 1, 0.0, 0, 0, "one"), ("i", 1, 0.0, 1, 0, "two"), ("j", 0, 0.0, 0, 0, "# u")],
                                  "inv_id string, section int, lead double, item bigint, part int, line string")
    path = str(tmp_path / "reports")
    S.save_reports(lines, path)
    folder = S.report_path(spark, path, "i")
    assert folder and S.report_path(spark, path, "none") is None
    assert "\n".join(r["value"] for r in spark.read.text(folder).collect()) == "# t\none\ntwo"
    assert K.report_texts(lines).count() == 2
    changes = spark.createDataFrame([("e", "open", START), ("e", "investigating", START + timedelta(hours=1)),
                                     ("f", "open", START)], "id string, status string, at timestamp")
    S.status_log(changes, str(tmp_path / "status"))
    outcome = spark.createDataFrame([("e", "failed", START + timedelta(hours=2))], "event_id string, status string, at timestamp")
    S.status_log(S.event_status_after(outcome), str(tmp_path / "status"))
    current = {r["id"]: r["status"] for r in S.current_status(spark.read.parquet(str(tmp_path / "status"))).collect()}
    assert current == {"e": "open", "f": "open"}
    S.append_events(changes, str(tmp_path / "events"))
    S.append_events(changes, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 6


def test_lineage_is_cut_in_the_configured_folder(spark):
    root = shared_root(spark)
    assert root and spark.sparkContext.getCheckpointDir()
    cut = cut_lineage(spark.range(5).selectExpr("id * 2 AS v"))
    assert cut.count() == 5 and "Scan ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
    assert root == (spark.conf.get("spark.checkpoint.dir", None) or root)


@pytest.mark.parametrize("allowed,bad", [({"status": schemas.EVENT_STATUSES}, 1), ({}, 0)])
def test_enumerations(spark, allowed, bad):
    df = spark.createDataFrame([("open",), (None,)], "status string")
    assert schemas.invalid_rows(df, allowed).count() == bad


def test_merge_rewrites_only_touched_dates(spark, tmp_path):
    path = str(tmp_path / "merged")
    rows = [("s", START + timedelta(hours=i), "cod", float(i)) for i in range(72)]
    stored = spark.createDataFrame(rows, schemas.READINGS).withColumn("version", F.lit(7))
    assert S.merge_readings(stored, path) == 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "merged").rglob("*.parquet")}
    new = [("s", START + timedelta(hours=25), "cod", 5.0, 1), ("s", START + timedelta(hours=25), "cod", 9.0, 2),
           ("s", START + timedelta(hours=25), "cod", 8.0, 2), ("t", START + timedelta(hours=26), "cod", None, 1), (None, START, "cod", 1.0, 3),
           ("s", START + timedelta(hours=30), "cod", 6.0, None)]
    assert S.merge_readings(spark.createDataFrame(new, f"{schemas.READINGS}, version bigint"), path) == 1
    got = {(r["station_id"], r["ts"]): r["value"] for r in S.read_readings(spark, path).collect()}
    expected = {(s, ts): v for s, ts, _, v in rows}
    expected |= {("s", START + timedelta(hours=25)): 9.0, ("s", START + timedelta(hours=30)): 6.0, ("t", START + timedelta(hours=26)): None}
    assert got == expected and S.read_readings(spark, path).count() == len(expected)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "merged").rglob("*.parquet")}
    kept = {p for p in before if "date=2024-03-02" not in str(p)}
    assert kept and all(after[p] == before[p] for p in kept)
    plan = S.stored_on(spark, path, [(START + timedelta(days=1)).date()])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [(date" in plan or "PartitionFilters: [date" in plan
    assert S.merge_readings(spark.createDataFrame([], f"{schemas.READINGS}, version bigint"), path) == 0
