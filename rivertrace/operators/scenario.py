"""Expected levels without noise, residuals, and what-if deltas of pollution scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.functions.plume import puff
from rivertrace.functions.timeparts import day_of_year, hour_of, in_hours, minutes_since, weekday_of
from rivertrace.operators.network import DEFAULT_Q_WASTE, downstream_paths
from rivertrace.session import spread

TWO_PI = 2 * math.pi


def outfall(enterprises: DataFrame, profiles: DataFrame) -> DataFrame:
    """Outfall concentration per enterprise and indicator: (enterprise_id, industry, indicator, conc)."""
    return enterprises.join(profiles, "industry").select(
        F.col("id").alias("enterprise_id"), "industry", F.explode("outfall_conc").alias("indicator", "conc")
    )


def outfall_conc(profile: Column, indicator: Column) -> Column:
    return F.coalesce(F.try_element_at(profile, indicator), F.lit(0.0))


def contributions(sources: DataFrame, enterprises: DataFrame, profiles: DataFrame) -> DataFrame:
    """Theoretical contribution per station, enterprise and indicator: conc * treat_rate * attenuation."""
    treat = F.coalesce(F.col("discharge_pattern.treat_rate"), F.lit(1.0))
    return (
        outfall(enterprises, profiles)
        .join(enterprises.select(F.col("id").alias("enterprise_id"), treat.alias("treat_rate")), "enterprise_id")
        .join(sources.select("enterprise_id", "station_id", "atten"), "enterprise_id")
        .select(
            "station_id", "enterprise_id", "indicator", "conc", "treat_rate", "atten",
            (F.col("conc") * F.col("treat_rate") * F.col("atten")).alias("contribution"),
        )
    )


def activity(pattern: Column, minutes: Column) -> Column:
    """Discharge activity without noise, 0 to 1.8; 0 for enterprises that discharge only in events."""
    hour = hour_of(minutes)

    def within(hours: Column) -> Column:
        return in_hours(hour, hours[0], hours[1])

    always = 0.9 + 0.1 * F.sin((hour - 9) * (TWO_PI / 24))
    shifts = F.when(within(pattern["active_hours"]), 1.0).otherwise(0.0)
    boost = F.coalesce(pattern["night_boost"], F.lit(1.0))
    night = F.coalesce(pattern["night_window"], F.array(F.lit(22), F.lit(3)))
    weekend = F.when(weekday_of(minutes) >= 5, F.coalesce(pattern["weekend_scale"], F.lit(1.0))).otherwise(1.0)
    season = 1 + F.coalesce(pattern["seasonal_amp"], F.lit(0.2)) * F.sin((day_of_year(minutes) - 60) * (TWO_PI / 365))
    level = (
        F.when(pattern["continuous"], always).otherwise(shifts)
        * F.when((boost > 1.0) & within(night), boost).otherwise(1.0)
        * weekend
        * season
    )
    return F.when(F.coalesce(pattern["event_only"], F.lit(False)), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.8), level))
    )


def baseline(base: Column, seasonal_amp: Column, phase: Column, minutes: Column, is_ph: Column) -> Column:
    """Level without enterprises: base times season times day curve; pH within 6.5-8, others >= 0.001."""
    season = 1 + seasonal_amp * F.sin((day_of_year(minutes) - 60) * (TWO_PI / 365))
    daily = F.coalesce(1 + 0.04 * F.sin((hour_of(minutes) - phase) * (TWO_PI / 24)), F.lit(1.0))
    level = base * season * daily
    return F.when(is_ph, F.greatest(F.lit(6.5), F.least(F.lit(8.0), level))).otherwise(
        F.greatest(F.lit(0.001), level)
    )


def indicator_baselines(spark) -> DataFrame:
    """The built-in base level, daily phase and seasonal amplitude per indicator."""
    rows = [
        (name, level, V.DAILY_PHASE[name], V.SEASONAL_AMPLITUDE[name], name == "ph")
        for name, level in V.BASE_LEVEL.items()
    ]
    return spark.createDataFrame(rows, "indicator string, base double, phase int, seasonal_amp double, is_ph boolean")


def expected_level(
    readings: DataFrame, baselines: DataFrame, parts: DataFrame, enterprises: DataFrame, epoch: Column
) -> DataFrame:
    """Readings with the noise-free level expected at their time, and the residual.

    Activity depends on the discharge pattern alone, so contributions are first summed per station,
    indicator and pattern class; an hour of a station then meets a few classes, not every enterprise.
    Readings within one minute of a station share the sum.
    """
    pattern = F.struct(
        *[
            F.col(f"discharge_pattern.{name}").alias(name)
            for name in (
                "continuous", "active_hours", "night_boost", "night_window", "weekend_scale", "seasonal_amp", "event_only"
            )
        ]
    )
    classes = (
        parts.join(enterprises.select(F.col("id").alias("enterprise_id"), pattern.alias("pattern")), "enterprise_id")
        .groupBy("station_id", "indicator", "pattern")
        .agg(F.sum("contribution").alias("contribution"))
    )
    timed = readings.withColumn("t_min", F.floor(minutes_since(F.col("ts"), epoch)).cast("double"))
    moments = timed.select("station_id", "indicator", "t_min").distinct()
    added = (
        moments.join(classes, ["station_id", "indicator"])
        .groupBy("station_id", "indicator", "t_min")
        .agg(F.sum(F.col("contribution") * activity(F.col("pattern"), F.col("t_min"))).alias("discharge"))
    )
    natural = baseline(
        F.col("base"), F.col("seasonal_amp"), F.col("phase"), F.col("t_min"), F.col("is_ph")
    )
    return (
        timed.join(baselines, "indicator")
        .join(added, ["station_id", "indicator", "t_min"], "left")
        .withColumn("expected", natural + F.coalesce("discharge", F.lit(0.0)))
        .select("station_id", "indicator", "ts", "value", "expected", (F.col("value") - F.col("expected")).alias("residual"))
    )


def whatif_deltas(
    scenarios: DataFrame,
    impact: DataFrame,
    closure: DataFrame,
    nodes: DataFrame,
    stations: DataFrame,
    enterprises: DataFrame,
    profiles: DataFrame,
    epoch: Column,
    interval_min: int = 15,
    last_ts: Column | None = None,
) -> DataFrame:
    """(scenario_id, station_id, indicator, ts, delta) of pollution scenarios.

    ``scenarios`` has scenario_id, etype, source_id, severity, onset_day, duration_d, mass_kg. Sudden
    spills have the shape of the plume scaled to its peak; periodic dumping happens from 22 to 03 h at a
    multiple of the normal flow; gradual failure ramps up linearly. Series without effect drop out.
    """
    multiplier = F.lit(1.0)
    for name, value in V.SEVERITY_MULTIPLIER.items():
        multiplier = F.when(F.col("severity") == name, F.lit(value)).otherwise(multiplier)
    q = F.coalesce(F.col("discharge_pattern.q_waste"), F.lit(DEFAULT_Q_WASTE)) * V.DUMP_FLOW_MULTIPLIER
    sources = enterprises.select(
        F.col("id").alias("source_id"), "industry", F.col("node_id").alias("src"), q.alias("q_dump")
    ).join(profiles.select("industry", "outfall_conc"), "industry")
    places = stations.select(F.col("id").alias("station_id"), F.col("node_id").alias("dst"), F.explode("indicators").alias("indicator"))
    flows = nodes.select(F.col("id").alias("dst"), F.col("flow").alias("q_station"))
    origin = nodes.select(
        F.col("id").alias("src"), "velocity", (F.col("flow") / F.col("velocity")).alias("area_m2"), "k"
    )
    reached = (
        scenarios.withColumn("multiplier", multiplier)
        .join(sources, "source_id")
        .join(impact.where("factor <> 0").select(F.col("enterprise_id").alias("source_id"), "station_id", "factor"), "source_id")
        .join(places, "station_id")
        .withColumn("conc", outfall_conc(F.col("outfall_conc"), F.col("indicator")))
        .where("conc <> 0")
        .join(flows, "dst")
        .join(origin, "src")
        .join(downstream_paths(closure).select("src", "dst", "distance_m"), ["src", "dst"])
    )
    # Steps run from the onset to its end, cut at the last known time of the data.
    per_day = 1440 // interval_min
    begin = F.col("onset_day") * per_day
    steps = F.floor(F.col("duration_d") * per_day).cast("int")
    if last_ts is not None:
        room = F.floor((F.unix_micros(last_ts) - F.unix_micros(epoch)) / (interval_min * 60_000_000)) + 1
        steps = F.least(steps, (room - begin).cast("int"))
    timed = (
        spread(reached.withColumn("steps", steps).where("steps > 0"), "scenario_id", "station_id", "indicator")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
        .withColumn("t_min", (begin + F.col("step")) * interval_min)
        .withColumn("t_h", F.col("step") * interval_min / 60.0)
    )
    plume = puff(*[F.col(c) for c in ("distance_m", "velocity", "area_m2", "k", "mass_kg", "t_h")])
    night = in_hours(hour_of(F.col("t_min")), F.lit(22), F.lit(3)).cast("double")
    ramp = F.col("step") / F.nullif(F.col("steps") - 1, F.lit(0)) * (1.5 * (F.col("multiplier") - 1.0))
    raw = (
        F.when(F.col("etype") == "sudden", plume)
        .when(
            F.col("etype") == "periodic",
            night * F.col("multiplier") * F.col("conc") * F.col("q_dump") / (F.col("q_dump") + F.col("q_station")),
        )
        .otherwise(F.coalesce(ramp, F.lit(0.0)) * F.col("conc") * F.col("factor"))
    )
    series = ["scenario_id", "station_id", "indicator"]
    valued = timed.withColumn("raw", raw).select(
        *series, "etype", "conc", "mass_kg", "raw",
        F.timestamp_micros(F.unix_micros(epoch) + (F.col("t_min") * F.lit(60_000_000).cast("bigint")).cast("bigint")).alias("ts"),
    )
    peaks = valued.groupBy(*series).agg(F.max(F.abs("raw")).alias("top"))
    size = F.sqrt(F.col("mass_kg") / V.SUDDEN_REFERENCE_KG)
    shaped = F.when(
        F.col("etype") == "sudden",
        F.when(F.col("top") > 1e-9, F.col("raw") / F.nullif(F.col("top"), F.lit(0.0)) * F.col("conc") * V.SUDDEN_SCALE * size)
        .otherwise(0.0),
    ).otherwise(F.col("raw"))
    strongest = F.when(
        F.col("etype") == "sudden", F.when(F.col("top") > 1e-9, F.abs("conc") * V.SUDDEN_SCALE * size).otherwise(0.0)
    ).otherwise(F.col("top"))
    return (
        valued.join(peaks, series)
        .where(strongest >= 1e-9)
        .select(*series, "ts", F.bround(shaped, 3).alias("delta"))
    )


def delta_peaks(deltas: DataFrame) -> DataFrame:
    """Largest delta per scenario, station and indicator."""
    return deltas.groupBy("scenario_id", "station_id", "indicator").agg(F.max("delta").alias("peak_delta"))


def affected_indicators(peaks: DataFrame) -> DataFrame:
    """Sorted distinct indicators a scenario touches."""
    return peaks.groupBy("scenario_id").agg(F.array_sort(F.collect_set("indicator")).alias("indicators"))


def add_deltas(readings: DataFrame, deltas: DataFrame) -> DataFrame:
    """Readings with the deltas of their key added; keys not among the readings have no effect."""
    key = ["station_id", "indicator", "ts"]
    total = deltas.groupBy(*key).agg(F.sum("delta").alias("delta"))
    return readings.join(total, key, "left").select(
        *key, (F.col("value") + F.coalesce("delta", F.lit(0.0))).alias("value")
    )
