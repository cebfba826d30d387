"""Queries on expected levels and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivertrace.operators import scenario as S
from rivertrace.plans.common import EPOCH, at, open_river, r, us
from rivertrace.plans.oracle_entities import with_entities

# Level, phase and season assumed for the indicators of the given tables.
BASELINES = [
    ("click", 18.0, 10, 0.12, False), ("error", 0.7, 8, 0.12, False), ("purchase", 0.12, 9, 0.12, False),
    ("signup", 0.003, None, 0.0, False), ("view", 7.3, 6, 0.01, True),
]


def _parts(river):
    return S.contributions(river.sources, river.enterprises, river.industry_profiles)


def contribution(spark, folder):
    return _parts(open_river(spark, folder)).select(
        "station_id", "enterprise_id", "indicator", "conc", "treat_rate", "atten", F.round("contribution", 12).alias("contribution")
    )


def expected_level(spark, folder):
    river = open_river(spark, folder)
    baselines = spark.createDataFrame(
        BASELINES, "indicator string, base double, phase int, seasonal_amp double, is_ph boolean"
    )
    found = S.expected_level(river.readings, baselines, _parts(river), river.enterprises, at(EPOCH))
    return found.select(
        "station_id", "indicator", us().alias("ts_us"), "value", r("expected", 4).alias("expected"), r("residual", 4).alias("residual")
    )


def _scenarios(river):
    return river.table("supplier").selectExpr(
        "s_suppkey AS scenario_id", "s_suppkey AS source_id",
        "CASE s_suppkey % 3 WHEN 0 THEN 'sudden' WHEN 1 THEN 'periodic' ELSE 'gradual' END AS etype",
        "CASE (s_suppkey DIV 3) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity",
        "s_suppkey % 28 AS onset_day", "1 + s_suppkey % 3 AS duration_d", "cast(50 + s_suppkey % 100 AS double) AS mass_kg",
    )


def _deltas(river):
    last = river.readings.agg(F.max("ts").alias("ts")).scalar()
    return S.whatif_deltas(
        _scenarios(river), river.impact, river.source_closure, river.nodes, river.stations, river.enterprises,
        river.industry_profiles, at(EPOCH), interval_min=60, last_ts=last,
    )


def whatif_delta(spark, folder):
    return _deltas(open_river(spark, folder)).select("scenario_id", "station_id", "indicator", us().alias("ts_us"), "delta")


def whatif_peaks(spark, folder):
    return S.delta_peaks(_deltas(open_river(spark, folder)))


def whatif_indicators(spark, folder):
    found = S.affected_indicators(S.delta_peaks(_deltas(open_river(spark, folder))))
    return found.select("scenario_id", F.array_join("indicators", ",").alias("indicators"))


def overlay_readings(spark, folder):
    river = open_river(spark, folder)
    return S.add_deltas(river.hourly_readings, _deltas(river)).select(
        "station_id", "indicator", us().alias("ts_us"), r("value", 4).alias("value")
    )


_PARTS = (
    ("parts", "SELECT i.station_id, i.enterprise_id, o.indicator, o.conc, e.treat_rate, i.factor AS atten,"
     " o.conc*e.treat_rate*i.factor AS contribution FROM impact i JOIN enterprises e ON e.id=i.enterprise_id"
     " JOIN outfall o ON o.industry=e.industry WHERE i.factor<>0"),
)


def _within(hour: str, start: str, end: str) -> str:
    return (
        f"(CASE WHEN {start}<={end} THEN {hour}>={start} AND {hour}<{end} ELSE {hour}>={start} OR {hour}<{end} END)"
    )


_ACTIVITY = (
    "CASE WHEN event_only THEN 0.0 ELSE greatest(0.0, least(1.8,"
    " CASE WHEN continuous THEN 0.9+0.1*sin((hour-9)*(2*pi()/24)) ELSE CASE WHEN " + _within("hour", "hour_from", "hour_to")
    + " THEN 1.0 ELSE 0.0 END END"
    " * CASE WHEN night_boost>1.0 AND (hour>=22 OR hour<3) THEN night_boost ELSE 1.0 END"
    " * CASE WHEN (day+3)%7>=5 THEN weekend_scale ELSE 1.0 END"
    " * (1+seasonal_amp*sin(((day+1)%365-60)*(2*pi()/365))))) END"
)
_BASE = (
    "(VALUES ('click',18.0::double,10::double,0.12::double,false),('error',0.7,8,0.12,false),('purchase',0.12,9,0.12,false),"
    "('signup',0.003,NULL,0.0,false),('view',7.3,6,0.01,true)) b(indicator,base,phase,amp,is_ph)"
)
_LEVEL = "base*(1+amp*sin(((day+1)%365-60)*(2*pi()/365)))*coalesce(1+0.04*sin((hour-phase)*(2*pi()/24)),1.0)"
_DELTAS = (
    ("scen", "SELECT s_suppkey AS scenario_id, s_suppkey%3 AS kind, CASE (s_suppkey//3)%3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.0 ELSE 2.5 END::double"
     " AS mult, s_suppkey%28 AS onset_day, 1+s_suppkey%3 AS duration_d, cast(50+s_suppkey%100 AS double) AS mass_kg FROM supplier"),
    ("room", "SELECT epoch_us(max(ts))-epoch_us(timestamp '2024-01-01') AS us FROM readings"),
    ("reached", "SELECT c.*, i.station_id, i.factor, o.indicator, o.conc, e.q_waste*6 AS q_dump, t.flow AS q_station, n.velocity AS vel,"
     " n.flow/n.velocity AS area, n.k, CASE WHEN p.hops=0 THEN 100.0 ELSE p.distance_m END AS d,"
     " least(c.duration_d*24, floor(room.us/3600000000.0)+1-c.onset_day*24)::bigint AS steps FROM scen c JOIN enterprises e ON e.id=c.scenario_id"
     " JOIN impact i ON i.enterprise_id=e.id JOIN outfall o ON o.industry=e.industry JOIN stations s ON s.id=i.station_id"
     " JOIN nodes t ON t.id=s.node_id JOIN nodes n ON n.id=e.node_id JOIN closure p ON p.src=e.node_id AND p.dst=s.node_id, room"
     " WHERE i.factor<>0 AND o.conc<>0"),
    ("timed", "SELECT *, greatest(step*3600.0::double,1.0) AS s, (onset_day*24+step)%24 AS hour FROM"
     " (SELECT *, unnest(range(steps)) AS step FROM reached WHERE steps>0)"),
    ("raws", "SELECT *, CASE kind WHEN 0 THEN greatest(0.0, mass_kg*1e6/(area*sqrt(40*pi()*s))*exp(-((d-vel*s)*(d-vel*s))/(40*s))*exp(-k*s/86400))"
     " WHEN 1 THEN CASE WHEN hour>=22 OR hour<3 THEN 1.0 ELSE 0.0 END*mult*conc*q_dump/(q_dump+q_station)"
     " ELSE coalesce(step::double/nullif(steps-1,0),0.0)*1.5*(mult-1)*conc*factor END AS raw FROM timed"),
    ("tops", "SELECT *, max(abs(raw)) OVER (PARTITION BY scenario_id, station_id, indicator) AS top FROM raws"),
    ("deltas", "SELECT scenario_id, station_id, indicator, timestamp '2024-01-01'+to_hours(cast(onset_day*24+step AS int)) AS ts,"
     " round_even(CASE WHEN kind=0 THEN CASE WHEN top>1e-9 THEN raw/top*conc*(1.0/12)*sqrt(mass_kg/80) ELSE 0.0 END ELSE raw END,3) AS delta"
     " FROM tops WHERE CASE WHEN kind=0 THEN CASE WHEN top>1e-9 THEN conc*(1.0/12)*sqrt(mass_kg/80) ELSE 0.0 END ELSE top END >= 1e-9"),
)
_NEEDS = ("impact", "outfall", "enterprises", "stations", "nodes", "closure", "readings")

QUERIES = {
    "contribution": (contribution, with_entities(
        "SELECT station_id, enterprise_id, indicator, conc, treat_rate, atten, round(contribution,12) AS contribution FROM parts",
        "impact", "enterprises", "outfall", extra=_PARTS)),
    "expected_level": (expected_level, with_entities(
        "SELECT m.station_id, m.indicator, epoch_us(m.ts) AS ts_us, m.value, round(natural_level+coalesce(a.discharge,0)+1e-9,4) AS expected,"
        " round(m.value-natural_level-coalesce(a.discharge,0)+1e-9,4) AS residual FROM (SELECT t.*, CASE WHEN is_ph THEN"
        f" greatest(6.5,least(8.0,{_LEVEL})) ELSE greatest(0.001,{_LEVEL}) END AS natural_level FROM times t JOIN {_BASE}"
        " ON b.indicator=t.indicator) m LEFT JOIN added a ON a.station_id=m.station_id AND a.indicator=m.indicator AND a.minute=m.minute",
        "impact", "enterprises", "outfall", "readings", extra=(
            *_PARTS,
            ("times", "SELECT *, (minute/60)%24 AS hour, floor(minute/1440) AS day FROM (SELECT *,"
             " floor((epoch_us(ts)-epoch_us(timestamp '2024-01-01'))/60000000.0) AS minute FROM readings)"),
            ("classes", "SELECT station_id, indicator, continuous, hour_from, hour_to, night_boost, weekend_scale, seasonal_amp, event_only,"
             " sum(contribution) AS c FROM parts p JOIN enterprises e ON e.id=p.enterprise_id GROUP BY ALL"),
            ("added", f"SELECT t.station_id, t.indicator, t.minute, sum(c*{_ACTIVITY}) AS discharge FROM (SELECT DISTINCT station_id,"
             " indicator, minute, hour, day FROM times) t JOIN classes c ON c.station_id=t.station_id AND c.indicator=t.indicator GROUP BY ALL"),
        ))),
    "whatif_delta": (whatif_delta, with_entities(
        "SELECT scenario_id, station_id, indicator, epoch_us(ts) AS ts_us, delta FROM deltas", *_NEEDS, extra=_DELTAS)),
    "whatif_peaks": (whatif_peaks, with_entities(
        "SELECT scenario_id, station_id, indicator, max(delta) AS peak_delta FROM deltas GROUP BY ALL", *_NEEDS, extra=_DELTAS)),
    "whatif_indicators": (whatif_indicators, with_entities(
        "SELECT scenario_id, string_agg(DISTINCT indicator, ',' ORDER BY indicator) AS indicators FROM deltas GROUP BY ALL",
        *_NEEDS, extra=_DELTAS)),
    "overlay_readings": (overlay_readings, with_entities(
        "SELECT h.station_id, h.indicator, epoch_us(h.ts) AS ts_us, round(h.value+coalesce(d.delta,0)+1e-9,4) AS value FROM hourly h"
        " LEFT JOIN (SELECT station_id, indicator, ts, sum(delta) AS delta FROM deltas GROUP BY ALL) d USING (station_id, indicator, ts)",
        *_NEEDS, "hourly", extra=_DELTAS)),
}
