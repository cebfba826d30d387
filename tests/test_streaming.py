"""Streams over several micro-batches equal the batch operators."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rivertrace.operators.detectors import detect_cusum
from rivertrace.plans import stream_queries as Q
from rivertrace.streaming import jobs as J

START = datetime(2024, 3, 1)
ONCE = {"availableNow": True}


def feed(spark, tmp_path, name, df, schema, cuts, by):
    """One file per slice of time; the stream takes one file per micro-batch."""
    folder = str(tmp_path / name)
    for low, high in zip(cuts, cuts[1:]):
        df.where((F.col(by) >= F.lit(low)) & (F.col(by) < F.lit(high))).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cusum_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = []
    for name in ("s1", "s2", "short"):
        n = 30 if name == "short" else 400
        x = rng.normal(10, 0.5, n)
        x[250:] += 1.0 if name == "s1" else -0.8
        parts.append(pd.DataFrame({"station_id": name, "indicator": "cod", "ts": [START + timedelta(minutes=15 * i) for i in range(n)], "value": x}))
    df = spark.createDataFrame(pd.concat(parts))
    cuts = [START + timedelta(minutes=15 * i) for i in (0, 30, 90, 255, 400)]
    stream = feed(spark, tmp_path, "in", df, df.schema, cuts, "ts")
    out = str(tmp_path / "out")
    for _ in range(2):
        J.stream_cusum(stream, str(tmp_path / "state"), out, str(tmp_path / "progress"), warmup_rows=50, block_seconds=20_000, trigger=ONCE).awaitTermination()
    got = {(r["station_id"], r["idx"]): r["zscore"] for r in spark.read.parquet(out).collect()}
    batch = detect_cusum(df.where("station_id <> 'short'"), warmup_rows=50)
    expected = {(r["station_id"], r["idx"]): r["zscore"] for r in batch.collect()}
    assert expected and set(got) == set(expected)
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_suppression_stream_equals_loop(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(f"a{i:03d}", f"s{rng.integers(2)}", START + timedelta(minutes=int(rng.integers(0, 20_000)))) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, station_id string, ts timestamp")
    cuts = [START + timedelta(minutes=m) for m in (0, 6_000, 20_001)]
    stream = feed(spark, tmp_path, "alerts", df, df.schema, cuts, "ts")
    out = str(tmp_path / "out")
    J.suppress_alerts(stream, str(tmp_path / "state"), out, str(tmp_path / "progress"), trigger=ONCE).awaitTermination()
    last, plain = {}, set()
    for i, s, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if s not in last or t - last[s] >= timedelta(hours=48):
            last[s] = t
            plain.add(i)
    assert {r["id"] for r in spark.read.parquet(out).collect()} == plain


def test_log_streams(spark, tmp_path):
    rows = [("i", n, START + timedelta(seconds=n), "step", f"s{n % 3}") for n in range(9)]
    df = spark.createDataFrame(rows, "inv_id string, seq bigint, at timestamp, type string, item_id string")
    cuts = [START + timedelta(seconds=n) for n in (0, 4, 9)]
    stream = feed(spark, tmp_path, "log", df, df.schema, cuts, "at")
    J.record_messages(stream, str(tmp_path / "json"), str(tmp_path / "p1"), trigger=ONCE).awaitTermination()
    J.record_messages(stream, str(tmp_path / "json"), str(tmp_path / "p1"), trigger=ONCE).awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 9
    first = J.first_messages(stream).writeStream.format("parquet").option("path", str(tmp_path / "first"))
    first.option("checkpointLocation", str(tmp_path / "p2")).trigger(**ONCE).start().awaitTermination()
    assert sorted(r["item_id"] for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["s0", "s1", "s2"]
    query, current = J.latest_hypotheses(stream, str(tmp_path / "latest"), str(tmp_path / "p3"), trigger=ONCE)
    query.awaitTermination()
    assert sorted(r["seq"] for r in current().collect()) == [6, 7, 8]


def test_items_survive_replays_and_a_restart(spark, tmp_path):
    rows = [("i", n, START + timedelta(seconds=n), ("step", "hypothesis", "talk")[n % 3], f"x{n % 9 // 3}", f"t{n}") for n in range(27)]
    late = [(i, n, START + timedelta(days=3, seconds=n), *more) for i, n, _, *more in rows[:9]]  # told again days later
    late += [("i", 40, START + timedelta(days=3), None, "x0", "no type"), (None, 41, START + timedelta(days=3), "step", None, "nobody")]
    df = spark.createDataFrame(rows + late, "inv_id string, seq bigint, at timestamp, type string, item_id string, text string")
    folder, schema = str(tmp_path / "log"), df.schema
    steps, hypotheses = ("step", str(tmp_path / "first"), str(tmp_path / "p1")), ("hypothesis", str(tmp_path / "last"), str(tmp_path / "p2"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        found = []
        for job, source, (_, out, progress) in (
            (J.first_steps, stream, steps), (J.latest_hypotheses, stream.where("type = 'hypothesis'"), hypotheses)
        ):
            query, current = job(source, out, progress, trigger=ONCE)
            query.awaitTermination()
            found.append(sorted((r["seq"], r["text"]) for r in current().collect()))
        return found

    def expected(seen):
        first, last = {}, {}
        for r in seen:
            if r[3] == "step" and (r[0], r[4]) not in first or r[3] == "step" and r[1] < first[r[0], r[4]][1]:
                first[r[0], r[4]] = r
            if r[3] == "hypothesis" and ((r[0], r[4]) not in last or r[1] > last[r[0], r[4]][1]):
                last[r[0], r[4]] = r
        kept = [*first.values(), *(r for r in seen if r[3] != "step")]
        return [sorted((r[1], r[5]) for r in kept), sorted((r[1], r[5]) for r in last.values())]

    def told(low, high):
        df.where((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high))).coalesce(1).write.mode("append").parquet(folder)

    told(START + timedelta(seconds=9), START + timedelta(seconds=18))
    assert run() == expected(rows[9:18])
    told(START, START + timedelta(seconds=9))  # earlier messages that come second
    told(START + timedelta(seconds=18), START + timedelta(days=1))
    assert run() == expected(rows)
    told(START + timedelta(days=1), START + timedelta(days=9))
    assert run() == expected(rows + late)
    assert run() == expected(rows + late)  # started again without anything new


def test_late_readings_and_readings_at_one_time(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 0.5, 200)
    x[120:] += 1.5
    kind = "station_id string, indicator string, ts timestamp, value double"
    rows = [("s", "cod", START + timedelta(minutes=15 * (i // 2)), float(v)) for i, v in enumerate(x)]  # two at a time
    df = spark.createDataFrame(rows, kind)
    cuts = [START + timedelta(minutes=m) for m in (0, 600, 900, 3000)]
    folder = str(tmp_path / "in")
    stream = feed(spark, tmp_path, "in", df, df.schema, cuts, "ts")
    paths = [str(tmp_path / name) for name in ("state", "out", "progress")]
    J.stream_cusum(stream, *paths, warmup_rows=50, trigger=ONCE, late_path=str(tmp_path / "late")).awaitTermination()
    spark.createDataFrame([("s", "cod", START + timedelta(minutes=30), 99.0)], kind).write.mode("append").parquet(folder)
    J.stream_cusum(stream, *paths, warmup_rows=50, trigger=ONCE, late_path=str(tmp_path / "late")).awaitTermination()
    got = {r["idx"]: r["zscore"] for r in spark.read.parquet(paths[1]).collect()}
    expected = {r["idx"]: r["zscore"] for r in detect_cusum(df, warmup_rows=50).collect()}
    assert expected and set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [99.0]


def test_streams_read_tables_kept_as_folders(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system")[t % 3], f"text {t}") for c in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    one, several, none = (tmp_path / name for name in ("one", "several", "none"))
    df.repartition(3).write.parquet(str(several / "conversations.parquet"))
    df.where("false").write.parquet(str(none / "conversations.parquet"))
    part = df.coalesce(1)
    part.write.parquet(str(tmp_path / "written"))
    one.mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(one / "conversations.parquet")
    for name in ("stream_log", "stream_first", "stream_steps", "stream_latest", "stream_guard"):
        query = Q.QUERIES[name][0]
        found = [sorted(map(str, query(spark, str(folder)).collect())) for folder in (one, several, none)]
        assert found[0] and found[0] == found[1] and found[2] == [], name
