"""Daily periodicity, whole series and slices, against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivertrace.operators import periodicity as P


def frame(spark, *series):
    parts = []
    for number, x in enumerate(series):
        ts = pd.to_datetime(np.arange(len(x)) * 900 + 1_700_000_000, unit="s")
        parts.append(pd.DataFrame({"station_id": f"s{number}", "indicator": "a", "ts": ts, "value": x}))
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def night_series(days=12):
    hours = (np.arange(96 * days) * 0.25) % 24
    return 2.5 + 6.25 * ((hours >= 22) | (hours < 3)) + np.random.default_rng(21).normal(0, 0.4, len(hours))


def plain(x, period=96):
    r = np.corrcoef(x[:-period], x[period:])[0, 1] if x.std() > 1e-12 else 0.0
    profile = x[: len(x) // period * period].reshape(-1, period).mean(axis=0)
    hour = np.arange(period) * 0.25
    limit = profile.mean() + max(0.3 * profile.std(), 1e-9)
    return {"strength": max(0.0, r), "peak_hour": hour[np.argmax(profile)], "active": int((profile > limit).sum()),
            "night": profile[(hour >= 22) | (hour < 3)].mean() / profile.mean()}


def test_whole_series(spark):
    night = night_series()
    got = {r["station_id"]: r for r in P.analyze_periodicity(
        frame(spark, night, np.full(96 * 5, 3.0), np.arange(100.0)), tile=200).collect()}
    expected = plain(night)
    row = got["s0"]
    assert row["night_share"] > 1.5 and row["strength"] == pytest.approx(expected["strength"], abs=6e-4)
    assert row["peak_hour"] == pytest.approx(expected["peak_hour"], abs=0.06) and len(row["active_hours"]) == expected["active"]
    assert got["s1"]["strength"] == 0.0 and got["s1"]["active_hours"] == []
    assert (got["s2"]["night_share"], got["s2"]["peak_hour"], got["s2"]["strength"]) == (1.0, None, 0.0)


def test_slices(spark):
    x = night_series(9)
    df = frame(spark, x)
    times = [r["ts"] for r in df.orderBy("ts").collect()]
    starts = spark.createDataFrame([("s0", "a", times[i]) for i in (0, 37, 37, 300, 800)], "station_id string, indicator string, since timestamp")
    got = {r["since"]: r for r in P.periodicity_from(df, starts, days=4).collect()}
    assert len(got) == 4
    for i in (0, 37, 300):
        part = x[i:i + 384]
        expected, row = plain(part), got[times[i]]
        assert row["judged"] and row["used_rows"] == 384 and row["strength"] == pytest.approx(expected["strength"], abs=6e-4)
        assert row["night_share"] == pytest.approx(expected["night"], abs=6e-4)
    short = got[times[800]]
    assert (short["strength"], short["night_share"], short["used_rows"]) == (0.0, 1.0, 0)
    assert short["judged"] is False
    assert df.agg(F.count("*")).first()[0] == len(x)


def test_dense_slices_keep_their_days(spark):
    """Four readings a minute of the usual grid: days are cut by time, not by a number of rows."""
    x = np.repeat(night_series(25), 2)
    ts = pd.to_datetime(np.arange(len(x)) * 450 + 1_700_000_000, unit="s")
    df = spark.createDataFrame(pd.DataFrame({"station_id": "s", "indicator": "a", "ts": ts, "value": x}))
    starts = df.agg(F.min("ts").alias("since")).select(F.lit("s").alias("station_id"), F.lit("a").alias("indicator"), "since")
    assert P.periodicity_from(df, starts, interval_min=15).first()["used_rows"] == 21 * 192
