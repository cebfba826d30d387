"""Read models, log reductions, texts and scenarios."""

import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.functions import timeparts as H
from rivertrace.functions.text import guarded_type, parse_indicators
from rivertrace.operators import casefile as K
from rivertrace.operators import readmodels as M
from rivertrace.operators import scenario as S

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(s, "cod", START + timedelta(hours=i), float((i * 7 + len(s)) % 23)) for s in ("s", "st") for i in range(200)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["station_id", "indicator", "ts", "value"]))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalar_forms(spark):
    for text, listed in [('["a","b"]', ["a", "b"]), ("a", ["a"]), ('"a"', ["a"]), (None, []), ("", []), ("[broken", ["[broken"])]:
        assert one(spark, parse_indicators(F.lit(text).cast("string"))) == listed
    for raw, kind in [('{"type":"step","data":{}}', "step"), ('{"type":"connected"}', None), ('{"type":"x"}', None), ("no", None)]:
        assert one(spark, guarded_type(F.lit(raw))) == kind
    assert one(spark, H.hour_set(F.lit(22), F.lit(3))) == [0, 1, 2, 22, 23]
    assert one(spark, H.set_overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, H.set_overlap(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0
    assert one(spark, H.percent(F.lit(0.98))) == "98%" and one(spark, H.percent(F.lit(0.125))) == "12%"
    assert one(spark, H.format_utc(F.lit(START).cast("timestamp"))) == "2024-03-01 00:00 UTC"
    assert one(spark, H.format_utc(F.lit(None).cast("timestamp"))) == "-"
    assert one(spark, H.even_grid(0.0, 1.0, 5)) == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_slices_and_events(spark, readings):
    thin = M.series_slice(readings, F.lit(START + timedelta(hours=10)).cast("timestamp"), step=7).where("station_id = 's'").orderBy("ts").collect()
    assert [r["ts"] for r in thin] == [START + timedelta(hours=10 + 7 * i) for i in range(28)] and {r["count"] for r in thin} == {28}
    assert M.station_series(readings, "st", "cod", F.lit(START).cast("timestamp"), limit=3).count() == 3
    events = spark.createDataFrame([(str(i), "open" if i % 2 else "resolved", START + timedelta(days=i % 5)) for i in range(60)],
                                   "id string, status string, onset_ts timestamp")
    listed = M.list_events(events, "open", 7).collect()
    assert len(listed) == 7 and listed[0]["onset_ts"] == START + timedelta(days=4)
    asked = spark.createDataFrame([("3",), ("none",)], "id string")
    assert {r["id"]: r["found"] for r in M.lookup(asked, events).collect()} == {"3": True, "none": False}


def test_contrast_and_playback_equal_loops(spark, readings):
    local = readings.collect()
    stations = spark.createDataFrame([("s", 1, ["cod"]), ("st", 2, ["cod"])], "id string, node_id int, indicators array<string>")
    onsets = [START + timedelta(hours=h) for h in (0, 50, 50.5, 150, 500)]
    events = spark.createDataFrame([(i, "s", t, "cod") for i, t in enumerate(onsets)], "id int, station_id string, onset_ts timestamp, indicator string")
    got = {r["id"]: (r["before"], r["after"]) for r in M.event_contrast(readings, events.drop("indicator"), stations).collect()}
    plain = {}
    for i, t in enumerate(onsets):
        past = [r["value"] for r in local if r["station_id"] == "s" and r["ts"] < t]
        later = [r["value"] for r in local if r["station_id"] == "s" and r["ts"] >= t]
        if past and later and max(later) > sum(past) / len(past) * 1.3:
            plain[i] = (pytest.approx(sum(past) / len(past)), max(later))
    assert got == plain and plain
    heat = M.playback_heat(readings, events, stations, step_s=1800, block_seconds=7 * 3600).where("station_id = 'st'").collect()
    assert len(heat) == 5 * 109
    for r in heat[::13]:
        t0, t1 = r["onset_ts"] - timedelta(hours=6), r["onset_ts"] + timedelta(hours=48)
        window = [(x["ts"], x["value"]) for x in local if x["station_id"] == "st" and t0 <= x["ts"] <= t1]
        seen = [v for t, v in sorted(window) if t <= r["at"]]
        peak = max((v for _, v in window), default=0.0)
        assert r["heat"] == pytest.approx(min(seen[-1] / peak, 1.0) if seen and peak > 0 else 0.0)


def test_log_reductions(spark):
    rows = [("i", 0, "step", "s1"), ("i", 1, "step", "s1"), ("i", 2, "step", "s2"), ("i", 3, "hypothesis", "h1"),
            ("i", 4, "hypothesis", "h1"), ("i", 5, "agent_talk", "x"), ("i", 6, "agent_talk", "x"), ("i", 7, "conclusion", "c"),
            ("i", 8, "conclusion", "c"), ("i", 9, "connected", "z")]
    log = spark.createDataFrame(rows, "inv_id string, seq int, type string, item_id string")
    assert sorted(r["seq"] for r in K.investigation_state(log).collect()) == [0, 2, 4, 5, 6, 8]


def test_search_and_compliance(spark):
    clauses = spark.createDataFrame(V.REGULATIONS, V.REGULATION_COLUMNS)
    hits = K.keyword_hits(clauses, ["COD", "nothing at all"]).groupBy("keyword").count().collect()
    assert {r["keyword"]: r["count"] for r in hits} == {"COD": 1, "nothing at all": 8}
    events = spark.createDataFrame([("a", ["tp", "cod"]), ("b", ["zzz"]), ("c", [])], "id string, indicators array<string>")
    texts = {r["id"]: r["text"] for r in K.compliance_texts(events, clauses, ["cod", "tp", "zzz"]).collect()}
    assert texts["a"].index("总磷") < texts["a"].index("COD") and "第六十五条" not in texts["a"]
    assert "第六十五条" in texts["b"] and "第八十三条" in texts["c"] and "第八十五条" not in texts["c"]
    plans = spark.createDataFrame([("a", "sudden", "high"), ("b", "odd", "low")], "id string, etype string, severity string")
    got = {r["id"]: r["text"] for r in K.response_texts(plans).collect()}
    assert "4. 组织泄漏源围堵与吸附处置" in got["a"] and "1. 复核自动监测数据" in got["b"]


def test_long_report_is_whole_and_in_order(spark):
    events = spark.createDataFrame([("i", "e", "sudden", "high", "s", ["cod"], START)],
                                   "inv_id string, event_id string, etype string, severity string, station_id string, indicators array<string>, onset_ts timestamp")
    steps = spark.range(3000).select(
        F.lit("i").alias("inv_id"), (F.col("id") * 1000).alias("seq"), F.lit("p").alias("phase"), F.lit("c").alias("clue"),
        F.lit("r").alias("reasoning"), F.array(F.struct(F.lit("k").alias("kind"), F.col("id").cast("string").alias("value"))).alias("evidence"))
    suspects = spark.createDataFrame([("i", 10, "A", "food", 0.499, "candidate"), ("i", 150, "B", "food", 0.5, "candidate")],
                                     "inv_id string, rank int, target_name string, industry string, score double, status string")
    verdict = spark.createDataFrame([("i", "resolved", "B", 0.9, "why", None, None)],
                                    "inv_id string, verdict string, source_name string, confidence double, evidence_summary string, reason string, suggestions array<string>")
    talks = spark.createDataFrame([("i", 99, "agent", "talk")], "inv_id string, seq int, agent string, text string")
    lines = K.report_lines(events, steps, suspects, verdict, talks)
    whole = K.report_texts(lines).collect()
    assert len(whole) == 1
    text = whole[0]["text"]
    assert text.count("\n") > 10_000
    assert text.startswith("# 水质污染溯源调查报告") and "### 3000. p" in text and "锁定污染源：B" in text
    assert text.index("- B（food）") < text.index("- A（food）") and text.count("### ") == 3000


def test_scenarios(spark):
    nodes = spark.createDataFrame([(1, 10.0, 0.5, 0.1), (2, 20.0, 0.5, 0.1)], "id int, flow double, velocity double, k double")
    closure = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.1), (1, 2, 1, 3600.0, 2.0, 0.1)],
                                    "src int, dst int, hops int, distance_m double, travel_h double, k_mean double")
    stations = spark.createDataFrame([("s", 2, ["cod", "tp"])], "id string, node_id int, indicators array<string>")
    enterprises = spark.createDataFrame([("e", "metal", 1)], "id string, industry string, node_id int").selectExpr(
        "*", "named_struct('q_waste', 0.01D, 'treat_rate', 0.5D) AS discharge_pattern")
    profiles = spark.createDataFrame([("metal", {"cod": 120.0})], "industry string, outfall_conc map<string,double>")
    impact = spark.createDataFrame([("e", "s", 0.25)], "enterprise_id string, station_id string, factor double")
    plans = spark.createDataFrame(
        [("p", "periodic", "e", "high", 1, 1, None), ("g", "gradual", "e", "medium", 1, 1, None), ("x", "sudden", "e", "low", 1, 1, 80.0)],
        "scenario_id string, etype string, source_id string, severity string, onset_day int, duration_d int, mass_kg double")
    deltas = S.whatif_deltas(plans, impact, closure, nodes, stations, enterprises, profiles, F.lit(START).cast("timestamp"))
    rows = deltas.collect()
    assert {r["indicator"] for r in rows} == {"cod"} and len(rows) == 3 * 96
    periodic = {r["ts"].hour: r["delta"] for r in rows if r["scenario_id"] == "p"}
    assert periodic[12] == 0.0 and periodic[23] == round(2.5 * 120 * 0.06 / 20.06, 3) and periodic[2] == periodic[23]
    peaks = {r["scenario_id"]: r["peak_delta"] for r in S.delta_peaks(deltas).collect()}
    assert peaks["g"] == round(1.5 * 120 * 0.25, 3) and peaks["x"] == round(120 / 12, 3)
    assert S.affected_indicators(S.delta_peaks(deltas)).first()["indicators"] == ["cod"]
    moment = START + timedelta(days=1, hours=23)
    held = spark.createDataFrame([("s", "cod", moment, 1.0), ("s", "tp", moment, 2.0)], "station_id string, indicator string, ts timestamp, value double")
    after = {r["indicator"]: r["value"] for r in S.add_deltas(held, deltas.where("scenario_id = 'p'")).collect()}
    assert after == {"cod": pytest.approx(1.0 + periodic[23]), "tp": 2.0}


def test_baseline_ranges(spark):
    grid = spark.range(96 * 5).withColumn("t_min", F.col("id") * 15.0).crossJoin(S.indicator_baselines(spark))
    level = S.baseline(F.col("base"), F.col("seasonal_amp"), F.col("phase"), F.col("t_min"), F.col("is_ph"))
    got = {r["indicator"]: (r["lo"], r["hi"]) for r in grid.groupBy("indicator").agg(F.min(level).alias("lo"), F.max(level).alias("hi")).collect()}
    assert 5 < got["cod"][0] and got["cod"][1] < 60 and 6.5 <= got["ph"][0] and got["ph"][1] <= 8.0
    pattern = F.expr("named_struct('continuous', false, 'active_hours', array(22, 3), 'night_boost', 1.2D, 'night_window', array(22, 3),"
                     " 'weekend_scale', 0.5D, 'seasonal_amp', 0D, 'event_only', false)")
    for minutes, value in [(23 * 60, 1.2), (12 * 60, 0.0), (2 * 1440 + 23 * 60, 0.6)]:
        assert one(spark, S.activity(pattern, F.lit(float(minutes)))) == pytest.approx(value)
    assert math.isclose(one(spark, S.activity(F.expr("named_struct('continuous', true, 'active_hours', array(0, 24), 'night_boost', 1D,"
                        " 'night_window', array(22, 3), 'weekend_scale', 1D, 'seasonal_amp', 0D, 'event_only', false)"), F.lit(15.0 * 60))), 1.0)
