"""Monitor scan, suppression, hypotheses, evidence and verdicts on small fixtures."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivertrace.operators import alerts as A
from rivertrace.operators import attribution as T
from rivertrace.operators import composition as C

START = datetime(2024, 3, 1)
EVENTS = "id string, station_id string, onset_ts timestamp, status string"


def series(spark, **named):
    parts = []
    for name, x in named.items():
        station, indicator = name.split("__")
        ts = [START + timedelta(minutes=15 * i) for i in range(len(x))]
        parts.append(pd.DataFrame({"station_id": station, "indicator": indicator, "ts": ts, "value": x}))
    return spark.createDataFrame(pd.concat(parts))


def burst(level=3.0, n=96):
    x = 1.0 + 0.02 * (-1.0) ** np.arange(n)
    x[60:] = level
    return x


def test_scan_takes_one_indicator_per_station(spark):
    readings = series(spark, s1__tp=burst(), s1__cod=burst(), s2__cod=burst(1.0), s3__cod=burst(), s4__cod=burst(n=40))
    stations = spark.createDataFrame([(s, ["cod", "tp"]) for s in ("s1", "s2", "s3", "s4")], "id string, indicators array<string>")
    now = START + timedelta(minutes=15 * 95)
    events = spark.createDataFrame(
        [("old", "s3", now - timedelta(hours=5), "open"), ("gone", "s1", now - timedelta(hours=5), "resolved"),
         ("far", "s1", now - timedelta(hours=60), "open")], EVENTS)
    found = A.scan_for_events(readings, stations, events).collect()
    assert [(r["station_id"], r["indicators"]) for r in found] == [("s1", ["cod"])]
    assert found[0]["severity"] == "high" and found[0]["etype"] == "detected" and len(found[0]["id"]) == 64
    again = A.scan_for_events(readings, stations, events).first()["id"]
    assert again == found[0]["id"]


def test_suppression_equals_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", f"s{rng.integers(3)}", START + timedelta(hours=float(rng.integers(0, 900)))) for i in range(120)]
    opens = [(f"o{i}", f"s{rng.integers(3)}", START + timedelta(hours=float(rng.integers(0, 900))), "open") for i in range(15)]
    new = spark.createDataFrame(rows, "id string, station_id string, ts timestamp")
    got = {r["id"] for r in A.suppress_duplicates(new, spark.createDataFrame(opens, EVENTS)).collect()}
    plain = {i for i, s, t in rows if not any(s == o[1] and t - timedelta(hours=48) < o[2] <= t for o in opens)}
    assert got == plain and 0 < len(got) < len(rows)


@pytest.mark.parametrize("block_seconds", [3600, 86_400, 40 * 86_400])
def test_chain_of_suppression_equals_loop(spark, block_seconds):
    rng = np.random.default_rng(11)
    rows = [(f"a{i:04d}", "busy" if i % 3 else f"s{rng.integers(4)}", START + timedelta(hours=int(rng.integers(0, 8800))), i)
            for i in range(900)]
    rows += [rows[5], ("b", "s1", rows[0][2], 0), ("edge0", "edge", START, 1), ("edge1", "edge", START + timedelta(hours=48), 2),
             ("edge2", "edge", START + timedelta(hours=95, minutes=59), 3), ("lone", "lone", START, 4)]
    silent = {"s0": START + timedelta(hours=500), "none": START}
    nulls = [("n1", None, START, 5), ("n2", "busy", None, 6)]
    df = spark.createDataFrame(rows + nulls, "id string, station_id string, ts timestamp, next int")
    until = spark.createDataFrame([*silent.items(), ("s0", None)], "station_id string, until timestamp")
    last, plain = {}, []
    for i, s, t, n in sorted(rows, key=lambda r: (r[2], r[0])):
        if (s not in last or t - last[s] >= timedelta(hours=48)) and not (s in silent and t <= silent[s]):
            last[s] = t
            plain.append((i, n))
    got = A.suppression_chain(df, silenced=until, block_seconds=block_seconds).collect()
    assert sorted((r["id"], r["next"]) for r in got) == sorted(plain + [("n1", 5), ("n2", 6)])
    assert {"edge0", "edge1", "lone"} <= {r["id"] for r in got}
    assert A.suppression_chain(df.limit(0)).columns == df.columns and A.suppression_chain(df.limit(0)).count() == 0


def test_hypotheses_follow_the_prior(spark):
    attens = [0.5, 0.004, 0.003, 0.002, 0.001, 0.0005, 0.0004]
    sources = spark.createDataFrame(
        [("s", i, f"E{i}", "food", 1, 2.0, a) for i, a in enumerate(attens)],
        "station_id string, enterprise_id bigint, name string, industry string, node_id bigint, travel_h double, atten double")
    events = spark.createDataFrame([("e1", "s", "periodic"), ("e2", "s", "sudden"), ("e3", "nowhere", "sudden")],
                                   "id string, station_id string, etype string")
    found = T.generate_hypotheses(events, T.station_hypotheses(sources))
    for event, bonus in (("e1", 0.15), ("e2", 0.0)):
        scored = sorted(((-round(min(0.6, a * 50 + bonus + 0.25 - i * 0.02), 3), i) for i, a in enumerate(attens[:6])))[:4]
        got = [(-r["prior"], r["enterprise_id"]) for r in found.where(F.col("event_id") == event).orderBy("hypothesis").collect()]
        assert got == scored
    assert found.where("event_id = 'e3'").count() == 0


def test_verification_and_verdict(spark):
    schema = ("event_id string, rank int, hypothesis string, enterprise_id string, name string, industry string, prior double, "
              "eem double, pollutant double, pattern double, strength double")
    rows = [
        ("a", 1, "h1", "x", "X", "food", 0.5, 0.9, 0.8, None, None), ("a", 2, "h2", "y", "Y", "food", 0.5, 0.2, 0.1, 0.3, None),
        ("b", 1, "h1", "x", "X", "food", 0.45, None, None, None, None), ("c", 1, "h1", "x", "X", "food", 0.5, 0.7, 0.7, None, 0.7),
        ("c", 2, "h2", "y", "Y", "food", 0.5, 0.7, 0.7, None, 0.7),
    ]
    verified = T.verify_hypotheses(spark.createDataFrame(rows, schema))
    got = {(r["event_id"], r["hypothesis"]): (r["score"], r["status"], r["evidence_count"]) for r in verified.collect()}
    assert got[("a", "h1")] == (round((0.9 * 0.4 + 0.8 * 0.25) / 0.65, 3), "candidate", 2)
    assert got[("a", "h2")][1] == "rejected" and got[("b", "h1")] == (0.45, "candidate", 0)
    assert T.evidence_rows(verified).where("event_id = 'a'").count() == 5
    events = spark.createDataFrame([(e, "sudden") for e in "abcd"], "id string, etype string")
    verdicts = {r["event_id"]: r for r in T.conclude(events, verified).collect()}
    assert verdicts["a"]["source_id"] == "x" and verdicts["a"]["verdict"] == "resolved"
    assert "86%" in verdicts["a"]["evidence_summary"]
    assert verdicts["b"]["verdict"] == "failed" and len(verdicts["b"]["suggestions"]) == 3
    assert verdicts["c"]["source_id"] == "x", "the earlier hypothesis wins a tie"
    assert len(verdicts["d"]["suggestions"]) == 1 and verdicts["d"]["confidence"] == 0.0
    truth = spark.createDataFrame([("a", "x"), ("c", "y"), ("b", "x")], "event_id string, truth_source string")
    compared = T.verdict_against_truth(T.conclude(events, verified), truth)
    assert {r["event_id"]: r["hit"] for r in compared.collect()} == {"a": True, "b": None, "c": False, "d": None}
    row = T.accuracy_table(compared).first()
    assert (row["events"], row["resolved"], row["hits"], row["hit_rate"]) == (4, 2, 1, 0.5)


@pytest.mark.parametrize("hours,score", [(0.0, 1.0), (6.0, 0.5), (13.0, 0.0)])
def test_travel_score(spark, hours, score):
    assert spark.range(1).select(T.travel_score(F.lit(hours)).alias("s")).first()["s"] == score


def test_evidence_is_rounded_on_the_scaled_value(spark):
    from rivertrace.functions.timeparts import rounded, rounded_even

    row = spark.range(1).select(
        rounded_even(F.lit(1.015) * 0.1, 3).alias("even"), rounded(F.lit(0.6231) / 6, 4).alias("up"),
        rounded_even(F.lit(0.0125), 3).alias("down"),
    ).first()
    assert tuple(row) == (0.102, 0.1039, 0.012)


def test_composition_score_rides_on_the_hypotheses(spark):
    """The same scores as by maps, in one row per hypothesis and without collecting a list per event."""
    parts = [(1, "a", 2.0), (1, "a", 1.0), (1, "b", 1.0), (2, "c", 5.0), (3, "a", 0.0), (9, "b", 4.0), (9, "c", 4.0), (8, "a", 7.0)]
    rows = spark.createDataFrame(parts, "key long, component string, amount double")
    observed, library = rows.withColumnRenamed("key", "event_id"), rows.withColumnRenamed("key", "enterprise_id")
    pairs = spark.createDataFrame([(e, c) for e in (1, 2, 3, 4) for c in (1, 8, 9, 7)], "event_id long, enterprise_id long")
    scored = T.with_composition(pairs, observed, library, ["a", "b", "c"])
    assert "collect_list" not in scored._jdf.queryExecution().toString()
    maps = C.as_map(rows.groupBy("key", "component").agg(F.sum("amount").alias("share")), "key")
    maps = maps.withColumn("pollutants", C.normalised(F.col("pollutants")))
    plain = T.composition_evidence(pairs, maps.withColumnRenamed("key", "sample_id"), maps.withColumnRenamed("key", "enterprise_id"))
    expected = {(r.event_id, r.enterprise_id): r.pollutant for r in plain.collect()}
    got = {(r.event_id, r.enterprise_id): r.pollutant for r in scored.collect()}
    assert len(got) == 16 and {k: v for k, v in got.items() if v is not None} == expected and len(expected) == 9


def test_pattern_scores_are_shared_by_alerts(spark):
    """Many alerts of one station, indicator and onset: one score per candidate, met by every periodic alert and by no other."""
    onset = datetime(2024, 1, 20)
    events = [(i, "periodic" if i % 4 else "sudden", "st", "cod", onset, c, c, c) for i in range(40) for c in (1, 2)]
    rows = spark.createDataFrame(
        events, "event_id long, etype string, station_id string, indicator string, onset_ts timestamp, enterprise_id long, sample_id long, rank int")
    readings = spark.createDataFrame([("st", "cod", datetime(2024, 1, 15), 1.0)], "station_id string, indicator string, ts timestamp, value double")
    pattern = T.pattern_evidence(rows, readings, spark.createDataFrame(
        [(1, ([8, 18],)), (2, ([8, 18],)), (3, ([8, 18],))], "id long, discharge_pattern struct<active_hours: array<int>>"))
    assert pattern.count() == 2
    none = spark.createDataFrame([], "sample_id long, enterprise_id long, cosine double, pearson double, eem double")
    bonuses = [("st", b, r, 0.5, f"N{r}", 3.0) for b in (0.0, 0.1, 0.15) for r in (1, 2)]
    ranked = spark.createDataFrame(bonuses, "station_id string, bonus double, rank int, prior double, name string, travel_h double")
    found = T.with_evidence(rows.withColumn("pollutant", F.lit(0.5)), none, None, pattern, ranked).collect()
    assert len(found) == 80 and {(r["etype"], r["pattern"], r["strength"]) for r in found} == {("periodic", 0.1, None), ("sudden", None, 0.75)}
    assert {(r["rank"], r["hypothesis"], r["name"]) for r in found} == {(1, "h1", "N1"), (2, "h2", "N2")}
