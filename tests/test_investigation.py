"""The investigation's log and the replay of status changes, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from rivertrace.operators import casefile as K
from rivertrace.operators import investigation as L

CHANGES = "id string, change bigint, status string, at timestamp"
START = datetime(2024, 1, 1)


def plain(rows, allowed, first):
    now, out = {}, []
    for id_, change, status, at in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2] is not None, r[2] or "")):
        before = now.get(id_, first)
        after = status if (before, status) in allowed else before
        out.append((id_, change, before, after, "moved" if after != before else "repeated" if before == status else "refused"))
        now[id_] = after
    return sorted(out)


@pytest.mark.parametrize("seconds", [60, 3600, 10**9])
def test_replay_equals_a_loop_for_any_block_length(spark, seconds):
    """One id holds a third of all rows; times tie, statuses repeat, some are null or unknown."""
    rng = random.Random(4)
    kinds = ["open", "investigating", "resolved", "closed", None]
    rows = [
        (rng.choice(["a"] * 5 + list("bcdefghij")), n, rng.choice(kinds[:3] * 3 + kinds), START + timedelta(minutes=rng.randrange(200)))
        for n in range(600)
    ]
    found = L.audit_changes(spark.createDataFrame(rows, CHANGES), block_seconds=seconds).collect()
    got = sorted((r["id"], r["change"], r["before"], r["after"], r["outcome"]) for r in found)
    assert got == plain(rows, L.EVENT_CHANGES, "open")
    assert {r["outcome"] for r in found} == {"moved", "repeated", "refused"}


def test_replay_of_nothing_and_of_rows_without_place(spark):
    assert L.audit_changes(spark.createDataFrame([], CHANGES)).collect() == []
    rows = [(None, 1, "open", START), ("a", 2, "open", None), ("a", 3, "investigating", START), ("a", 3, "investigating", START)]
    found = L.audit_changes(spark.createDataFrame(rows, CHANGES)).collect()
    assert sorted((r["id"], r["outcome"]) for r in found) == [("a", "moved"), ("a", "repeated")]


@pytest.fixture(scope="module")
def messages(spark):
    events = spark.createDataFrame(
        [(1, "st_1", ["cod", "tp"], "sudden", "high"), (2, "st_2", [], "gradual", "low"), (3, "st_3", ["tp"], "periodic", "low")],
        "id bigint, station_id string, indicators array<string>, etype string, severity string")
    verified = spark.createDataFrame(
        [(1, "h1", 1, "N1", 0.5, 0.9, None, None, 0.4, 0.76, "candidate"), (1, "h2", 2, "N2", 0.4, 0.1, 0.2, None, 0.1, 0.13, "rejected"),
         (3, "h1", 1, "N3", 0.2, None, None, None, None, 0.2, "rejected")],
        "event_id bigint, hypothesis string, rank int, name string, prior double, eem double, pollutant double, pattern double,"
        " strength double, score double, status string")
    verdicts = spark.createDataFrame(
        [(1, "N1", 0.76, "resolved", "basis", None), (2, None, 0.0, "failed", None, "no source"), (3, None, 0.0, "failed", None, "low")],
        "event_id bigint, source_name string, confidence double, verdict string, evidence_summary string, reason string")
    return L.investigation_messages(events, verified, verdicts)


def test_messages_come_in_order(messages):
    rows = messages.where("inv_id = '1'").orderBy("seq").collect()
    assert [(r["type"], r["item_id"], r["score"]) for r in rows] == [
        ("step", "parse", None), ("hypothesis", "h1", 0.5), ("hypothesis", "h2", 0.4),
        ("step", "h1_eem", 0.9), ("step", "h1_strength", 0.4), ("hypothesis", "h1", 0.76),
        ("step", "h2_eem", 0.1), ("step", "h2_pollutant", 0.2), ("step", "h2_strength", 0.1), ("step", "h2_drop", 0.13),
        ("hypothesis", "h2", 0.13), ("conclusion", None, 0.76), ("report_ready", None, None)]
    assert [r["type"] for r in messages.where("inv_id = '2'").orderBy("seq").collect()] == ["step", "failed", "report_ready"]


def test_reader_sees_the_outcome_once(messages):
    again = messages.unionByName(messages.selectExpr("inv_id", "seq + 5000 AS seq", *messages.columns[2:]))
    seen = K.investigation_state(again).where("inv_id = '3'").collect()
    assert sorted((r["type"], r["item_id"] or "", r["status"]) for r in seen if r["type"] != "report_ready") == [
        ("failed", "", "failed"), ("hypothesis", "h1", "rejected"), ("step", "h1_drop", "rejected"), ("step", "parse", "verified")]
    assert len(seen) == 5


def test_outcome_settles_investigation_and_alert(spark, messages):
    started = spark.createDataFrame([(str(i), START) for i in (1, 2, 3, 4)], "inv_id string, at timestamp")
    runs, alerts = L.outcome_changes(messages, started)
    ends = {}
    for name, log in (("run", L.audit_changes(runs, L.INVESTIGATION_CHANGES, L.INVESTIGATION_FIRST)), ("alert", L.audit_changes(alerts))):
        rows = log.orderBy("id", "at").collect()
        assert all(r["outcome"] == "moved" for r in rows)
        ends[name] = {r["id"]: r["after"] for r in rows}
    assert ends["run"] == {"1": "resolved", "2": "failed", "3": "failed", "4": "running"}
    assert ends["alert"] == {"1": "resolved", "2": "open", "3": "open", "4": "investigating"}


def test_block_maps_leave_once_per_batch():
    """A table per block made the replay of many short logs slow; unknown and null statuses change nothing."""
    import pandas as pd

    states = ["investigating", "open", "resolved"]
    parts = [
        pd.DataFrame({"id": [1, 1, 2, 3], "block": [0, 0, 5, 7], "status": ["investigating", "resolved", None, "open"]}),
        pd.DataFrame({"id": [3, 4], "block": [7, 7], "status": ["investigating", "lost"]}),
    ]
    found = list(L._block_maps(states, L.EVENT_CHANGES)(iter(parts)))
    assert len(found) == 3
    assert [(r.id, r.block, list(r.ends)) for r in pd.concat(found).itertuples()] == [
        (1, 0, ["resolved"] * 3), (2, 5, states), (3, 7, ["investigating", "investigating", "resolved"]), (4, 7, states)]


def test_reader_is_sent_no_column_twice(spark, messages):
    """Keys and the one type of a kind do not travel again beside the key; the rows are those of plain loops."""
    again = messages.unionByName(messages.withColumn("seq", messages["seq"] + 10 * L.OUTCOME))
    state = K.investigation_state(again)
    plan = state._jdf.queryExecution().analyzed().toString()
    assert "struct(inv_id" not in plan and "min_by(struct(seq" in plan.replace("named_", "")
    steps, last = {}, {}
    for r in sorted(again.collect(), key=lambda r: r["seq"]):
        if r["type"] == "step":
            steps.setdefault((r["inv_id"], r["item_id"]), r)
        else:
            last[r["inv_id"], r["type"], r["item_id"] if r["type"] == "hypothesis" else None] = r
    assert state.columns == messages.columns
    assert sorted(map(str, state.collect())) == sorted(map(str, [*steps.values(), *last.values()]))
