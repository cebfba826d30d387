"""Queries on readings: detectors, periodicity, contrasts, the monitor scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivertrace.functions.text import parse_indicators
from rivertrace.functions.timeparts import hour_set, set_overlap
from rivertrace.operators import alerts as A
from rivertrace.operators import detectors as D
from rivertrace.operators import periodicity as P
from rivertrace.operators import quantiles as Q
from rivertrace.operators import readmodels as M
from rivertrace.plans.common import at, open_river, r, us
from rivertrace.plans.oracle_entities import with_entities
from rivertrace.session import scratch_path
from rivertrace.sources import stores as ST

CUTOFF = "2024-01-11 00:00:00"
SCAN_HOURS = 240


def _published(anomalies):
    """Records for output. A score against a deviation of zero is of the order 1e13, where a double has no
    second decimal: from a million on it is given in ten thousands."""
    record = D.anomaly_record(anomalies)
    score = F.when(F.abs("zscore") >= 1e6, F.round("zscore", -4)).otherwise(F.col("zscore"))
    return record.select("station_id", "indicator", "idx", us().alias("ts_us"), "value", "baseline", score.alias("zscore"), "severity")


def three_sigma(spark, folder):
    river = open_river(spark, folder)
    return _published(D.detect(river.readings, "threesigma", window=25, block_seconds=river.block_seconds))


def cusum_alarms(spark, folder):
    river = open_river(spark, folder)
    return _published(D.detect(river.readings, "cusum", block_seconds=river.block_seconds))


def ewma_alarms(spark, folder):
    river = open_river(spark, folder)
    return _published(D.detect(river.readings, "ewma", block_seconds=river.block_seconds))


def seasonal_anomalies(spark, folder):
    river = open_river(spark, folder)
    return _published(D.detect(river.readings, "seasonal", period=24, block_seconds=river.block_seconds))


def robust_scale(spark, folder):
    found = Q.robust_scale(open_river(spark, folder).readings, ["station_id", "indicator"])
    return found.select("station_id", "indicator", r("median", 4).alias("median"), r("sigma", 4).alias("sigma"))


def _features(df, *keys):
    hours = F.array_join(F.transform("active_hours", lambda h: F.format_string("%.1f", h)), ",")
    return df.select(*keys, hours.alias("active_hours"), "peak_hour", "night_share", "strength")


def daily_profile(spark, folder):
    series = open_river(spark, folder).hourly_indicator_series
    return _features(P.analyze_periodicity(series, interval_min=60), "indicator", "n", "period_points", "autocorr")


def _periodic_starts(river):
    alerts = river.alerts.where("etype = 'periodic'")
    first = F.coalesce(F.try_element_at(parse_indicators(F.col("indicators")), F.lit(1)), F.lit("click"))
    return alerts.select(
        "station_id", first.alias("indicator"), (F.col("onset_ts") - F.make_dt_interval(F.lit(7))).alias("since")
    )


def event_periodicity(spark, folder):
    river = open_river(spark, folder)
    found = P.periodicity_from(river.readings, _periodic_starts(river), block_seconds=river.block_seconds)
    return _features(
        found, "station_id", "indicator", us("since").alias("since_us"), F.col("used_rows").cast("bigint").alias("used_rows")
    )


def monitor_scan(spark, folder):
    river = open_river(spark, folder)
    found = A.scan_for_events(river.readings, river.stations, river.alerts, window_h=SCAN_HOURS, block_seconds=river.block_seconds)
    return found.select(
        "id", "station_id", F.array_join("indicators", ",").alias("indicators"), us("onset_ts").alias("onset_us"),
        "severity", "etype", "status", F.bround("zscore", 2).alias("zscore"),
    )


def open_alert_suppression(spark, folder):
    alerts = open_river(spark, folder).alerts
    new = alerts.where("status <> 'open'").select("id", "station_id", F.col("created_at").alias("ts"))
    existing = alerts.select("station_id", "status", F.col("created_at").alias("onset_ts"))
    return A.suppress_duplicates(new, existing).select("id", "station_id", us().alias("ts_us"))


def suppression_chain(spark, folder):
    """Alerts of all years in order of entry: each one raised silences its station for 48 hours."""
    alerts = open_river(spark, folder).alerts.select("id", "station_id", F.col("created_at").alias("ts"), "severity")
    return A.suppression_chain(alerts).select("id", "station_id", us().alias("ts_us"), "severity")


def event_contrast(spark, folder):
    river = open_river(spark, folder)
    found = M.event_contrast(river.readings, river.alerts.select("id", "etype", "station_id", "onset_ts"), river.stations, block_seconds=river.block_seconds)
    return found.select(
        "id", "etype", "station_id", "indicator", r("before", 4).alias("before"), "after", r("ratio", 4).alias("ratio")
    )


def baseline_summary(spark, folder):
    found = M.baseline_summary(open_river(spark, folder).readings, at(CUTOFF))
    return found.select("station_id", "indicator", r("avg_value", 4).alias("avg_value"), "min_value", "max_value")


def top_peaks(spark, folder):
    found = M.top_peaks(open_river(spark, folder).readings, at(CUTOFF))
    return found.select("station_id", "indicator", us().alias("ts_us"), "value", F.col("rank").cast("bigint").alias("rank"))


def series_slice(spark, folder):
    found = M.series_slice(open_river(spark, folder).readings, at("2024-01-05 00:00:00"), at("2024-01-20 12:00:00"))
    return found.select("station_id", "indicator", us().alias("ts_us"), "value", "count")


def series_stride(spark, folder):
    river = open_river(spark, folder)
    found = M.series_slice(river.readings, step=4, block_seconds=river.block_seconds)
    return found.select("station_id", "indicator", us().alias("ts_us"), "value", "count")


def series_since(spark, folder):
    river = open_river(spark, folder)
    found = M.series_from(river.readings, at("2024-01-03 00:00:00"), block_seconds=river.block_seconds)
    return found.select("station_id", "indicator", us().alias("ts_us"), "value", "idx")


def playback_heat(spark, folder):
    river = open_river(spark, folder)
    first = F.try_element_at(parse_indicators(F.col("indicators")), F.lit(1))
    events = river.alerts.select(first.alias("indicator"), "onset_ts").where("indicator IS NOT NULL")
    found = M.playback_heat(river.readings, events, river.stations, block_seconds=river.block_seconds)
    return found.select(
        "indicator", us("onset_ts").alias("onset_us"), "station_id", us("at").alias("at_us"), "value", r("heat", 4).alias("heat")
    )


def hour_overlap(spark, folder):
    """Working hours of each enterprise against the night hours 22 to 3."""
    hours = F.col("discharge_pattern.active_hours")
    own = hour_set(hours[0], hours[1])
    return open_river(spark, folder).enterprises.select(
        "id", F.array_join(own.cast("array<string>"), ",").alias("hours"),
        r(set_overlap(own, hour_set(F.lit(22), F.lit(3))), 4).alias("overlap"),
    )


def _versioned_events(spark, folder):
    """All events as hourly readings, the event's number as version."""
    return open_river(spark, folder).table("events").select(
        F.concat(F.lit("st_"), F.lpad((3 * (F.col("user_id") % 9)).cast("string"), 2, "0")).alias("station_id"),
        F.col("event_type").alias("indicator"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        "value", F.col("event_id").alias("version"),
    )


def readings_merge(spark, folder):
    """Writes all events as a store by date, merges those of Mondays from a value of 50 on as corrections, reads it back."""
    events = _versioned_events(spark, folder).withColumn("late", F.coalesce(F.expr("value >= 50 AND weekday(ts) = 0"), F.lit(False)))
    path = scratch_path(spark, "store")
    ST.merge_readings(events.where("NOT late"), path)
    ST.merge_readings(events.where("late"), path)
    return ST.read_readings(spark, path).select("station_id", "indicator", us().alias("ts_us"), "value")


def readings_upsert(spark, folder):
    """Insert-or-replace of all events on (station, indicator, hour): the later event wins."""
    events = _versioned_events(spark, folder)
    old, new = events.where("value < 50"), events.where("value >= 50")
    return M.upsert_readings(old, new).select("station_id", "indicator", us().alias("ts_us"), "value")


_SERIES = "PARTITION BY station_id, indicator"
_SCORE = "CASE WHEN abs(z)>=1e6 THEN round(z,-4) ELSE round(z,2) END"


def _record(source: str, where: str) -> str:
    return (
        "SELECT station_id, indicator, idx, epoch_us(ts) AS ts_us, round(value,4) AS value, round(base,4) AS baseline,"
        f" {_SCORE} AS zscore, CASE WHEN abs(z)>=5 OR value/greatest(base,1e-9)>=2 THEN 'high'"
        f" WHEN abs(z)>=3 THEN 'medium' ELSE 'low' END AS severity FROM {source} WHERE {where}"
    )


def _scales(source: str, condition: str = "true") -> tuple[tuple[str, str], ...]:
    return (
        ("med", f"SELECT station_id, indicator, median(value) AS mu FROM {source} WHERE {condition} GROUP BY ALL"),
        ("scales", "SELECT p.station_id, p.indicator, any_value(mu) AS mu,"
         f" greatest(1.4826*median(abs(value-mu)),1e-9) AS sd FROM {source} p JOIN med m"
         f" ON m.station_id=p.station_id AND m.indicator=p.indicator WHERE {condition} GROUP BY ALL"),
    )


def _cusum(source: str) -> tuple[tuple[str, str], ...]:
    return (
        *_scales(source, "idx < greatest(floor(n*0.1),10)"),
        ("walk", f"SELECT p.*, mu AS base, sum((value-mu)/sd-0.5) OVER w AS cu, sum(-(value-mu)/sd-0.5) OVER w AS cd"
         f" FROM {source} p JOIN scales s ON s.station_id=p.station_id AND s.indicator=p.indicator"
         " WINDOW w AS (PARTITION BY p.station_id, p.indicator ORDER BY idx)"),
        ("stat", "SELECT *, greatest(cu-least(0,min(cu) OVER w), cd-least(0,min(cd) OVER w)) AS s FROM walk"
         f" WINDOW w AS ({_SERIES} ORDER BY idx)"),
        ("cusum", f"SELECT *, s/7 AS z, lag(s,1,0) OVER ({_SERIES} ORDER BY idx) AS last FROM stat"),
    )




def _profile(keys: str, source: str, period: int, interval_min: int) -> tuple[tuple[str, str], ...]:
    """Periodicity features of ``source`` (keys, idx, n, value)."""
    return (
        ("pairs", f"SELECT *, lag(value,{period}) OVER (PARTITION BY {keys} ORDER BY idx) AS past FROM {source}"),
        ("feat", f"SELECT {keys}, max(n) AS n, CASE WHEN stddev_pop(CASE WHEN past IS NOT NULL THEN value END)>1e-12"
         f" AND stddev_pop(past)>1e-12 THEN corr(value, past) ELSE 0 END AS rr FROM pairs GROUP BY {keys}"),
        ("prof", f"SELECT {keys}, (idx%{period})*{interval_min}/60.0 AS hour, avg(value) AS lvl FROM {source}"
         f" WHERE idx < floor(n/{period})*{period} GROUP BY {keys}, idx%{period}"),
        ("shape", f"SELECT {keys}, avg(lvl) AS overall, stddev_pop(lvl) AS sd FROM prof GROUP BY {keys}"),
        ("marked", "SELECT p.*, overall, sd FROM prof p JOIN shape s USING (" + keys + ")"),
        ("feats", f"SELECT {keys}, arg_min(hour, hour) FILTER (WHERE lvl=top) AS peak_hour,"
         " string_agg(printf('%.1f', round_even(hour,1)), ',' ORDER BY hour) FILTER (WHERE lvl>overall+greatest(0.3*sd,1e-9)) AS active_hours,"
         " avg(lvl) FILTER (WHERE hour>=22 OR hour<3)/greatest(any_value(overall),1e-9) AS night"
         f" FROM (SELECT *, max(lvl) OVER (PARTITION BY {keys}) AS top FROM marked) GROUP BY {keys}"),
    )


_SLICES = (
    ("wanted", "SELECT DISTINCT station_id, coalesce(indicators[1],'click') AS indicator, onset_ts - INTERVAL 7 DAY AS since"
     " FROM alerts WHERE etype='periodic'"),
    ("members", "SELECT station_id, indicator, since, idx, value, n FROM (SELECT w.station_id, w.indicator,"
     " w.since, p.value, row_number() OVER s - 1 AS idx, count(*) OVER (PARTITION BY w.station_id, w.indicator, w.since) AS n"
     " FROM wanted w JOIN readings p ON p.station_id=w.station_id AND p.indicator=w.indicator AND p.ts>=w.since AND p.ts<w.since + INTERVAL 21 DAY"
     " WINDOW s AS (PARTITION BY w.station_id, w.indicator, w.since ORDER BY p.ts, p.value)) WHERE n>=200"),
)

_WATCHED = "(VALUES (0,'click'),(1,'error'),(2,'purchase'),(3,'signup'),(4,'view')) o(pos,indicator)"

QUERIES = {
    "three_sigma": (three_sigma, with_entities(
        _record("scored", "abs(z)>3"), "positioned", extra=(
            ("rolled", f"SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM positioned WHERE n>=25"
             f" WINDOW w AS ({_SERIES} ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"),
            ("scored", "SELECT a.station_id, a.indicator, a.idx, a.ts, a.value, b.m AS base, (a.value-b.m)/greatest(b.s,1e-12) AS z"
             " FROM rolled a JOIN rolled b ON b.station_id=a.station_id AND b.indicator=a.indicator"
             " AND b.idx=least(greatest(a.idx,12),a.n-13)"),
        ))),
    "cusum_alarms": (cusum_alarms, with_entities(_record("cusum", "s>7 AND last<=7"), "positioned", extra=_cusum("positioned"))),
    "ewma_alarms": (ewma_alarms, with_entities(
        _record("scored", "abs(z)>3"), "positioned", extra=(
            *_scales("positioned"),
            ("smooth", "SELECT station_id, indicator, idx, ts, value, value AS e FROM positioned WHERE idx=0 UNION ALL"
             " SELECT p.station_id, p.indicator, p.idx, p.ts, p.value, 0.3*p.value+0.7*s.e FROM smooth s JOIN positioned p"
             " ON p.station_id=s.station_id AND p.indicator=s.indicator AND p.idx=s.idx+1"),
            ("scored", "SELECT p.*, mu AS base, (e-mu)/greatest(sqrt(sd*sd*(0.3/1.7)*(1-power(0.7,2*(idx+1)))),1e-12) AS z"
             " FROM smooth p JOIN scales s ON s.station_id=p.station_id AND s.indicator=p.indicator"),
        ))),
    "seasonal_anomalies": (seasonal_anomalies, with_entities(
        _record("scored", "abs(z)>3"), "positioned", extra=(
            ("hist", "SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM positioned"
             " WINDOW w AS (PARTITION BY station_id, indicator, idx%24 ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"),
            ("scored", "SELECT *, coalesce(m,value) AS base, (value-coalesce(m,value))/greatest(coalesce(s,0),1e-12) AS z FROM hist"),
        ))),
    "robust_scale": (robust_scale, with_entities(
        "SELECT station_id, indicator, round(mu+1e-9,4) AS median, round(sd+1e-9,4) AS sigma FROM scales",
        "positioned", extra=_scales("positioned"))),
    "daily_profile": (daily_profile, with_entities(
        "SELECT f.indicator, cast(f.n AS bigint) AS n, 24 AS period_points, round(greatest(rr,0),3) AS autocorr, active_hours, peak_hour,"
        " round(night,3) AS night_share, round(greatest(rr,0),3) AS strength FROM feat f JOIN feats USING (indicator)",
        "river_hourly", extra=(
            ("river_rows", "SELECT indicator, value, row_number() OVER (PARTITION BY indicator ORDER BY ts)-1 AS idx,"
             " count(*) OVER (PARTITION BY indicator) AS n FROM river_hourly"),
            *_profile("indicator", "river_rows", 24, 60),
        ))),
    "event_periodicity": (event_periodicity, with_entities(
        "SELECT w.station_id, w.indicator, epoch_us(w.since) AS since_us, cast(coalesce(f.n,0) AS bigint) AS used_rows,"
        " coalesce(active_hours,'') AS active_hours, round_even(peak_hour,1) AS peak_hour, coalesce(round(night,3),1.0) AS night_share,"
        " coalesce(round(greatest(rr,0),3),0.0) AS strength FROM wanted w LEFT JOIN feat f USING (station_id, indicator, since)"
        " LEFT JOIN feats g USING (station_id, indicator, since)",
        "readings", "alerts", extra=(*_SLICES, *_profile("station_id, indicator, since", "members", 96, 15)))),
    "monitor_scan": (monitor_scan, with_entities(
        "SELECT sha256(concat_ws('|', station_id, indicator, cast(epoch_us(ts) AS varchar))) AS id, station_id,"
        " indicator AS indicators, epoch_us(ts) AS onset_us, severity, 'detected' AS etype, 'open' AS status, zscore FROM queue q"
        " WHERE coalesce(silenced,0)=0 AND NOT EXISTS (SELECT 1 FROM alerts l, now WHERE l.station_id=q.station_id"
        " AND l.status='open' AND l.onset_ts > now.t - INTERVAL 48 HOUR)",
        "readings", "alerts", extra=(
            ("now", "SELECT max(ts) AS t FROM readings"),
            ("recent", "SELECT station_id, indicator, r.ts, r.value, row_number() OVER w - 1 AS idx,"
             " count(*) OVER (PARTITION BY station_id, indicator) AS n FROM readings r, now"
             f" WHERE r.ts >= now.t - INTERVAL {SCAN_HOURS} HOUR WINDOW w AS (PARTITION BY station_id, indicator ORDER BY r.ts)"),
            ("judged", "SELECT * FROM recent WHERE n>=48"),
            *_cusum("judged"),
            ("fired", _record("(SELECT * FROM cusum)", "s>7 AND last<=7")),
            ("first_severe", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, indicator ORDER BY idx) AS rn"
             " FROM fired WHERE severity<>'low') WHERE rn=1"),
            ("queue", "SELECT f.station_id, f.indicator, make_timestamp(f.ts_us) AS ts, f.severity, f.zscore,"
             " max(CASE WHEN make_timestamp(f.ts_us) > now.t - INTERVAL 48 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY f.station_id"
             f" ORDER BY o.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS silenced FROM first_severe f JOIN {_WATCHED}"
             " ON o.indicator=f.indicator, now"),
        ))),
    "open_alert_suppression": (open_alert_suppression, with_entities(
        "SELECT a.id, a.station_id, epoch_us(a.created_at) AS ts_us FROM alerts a WHERE a.status<>'open' AND NOT EXISTS"
        " (SELECT 1 FROM opened o WHERE o.station_id=a.station_id AND o.created_at<=a.created_at"
        " AND o.created_at > a.created_at - INTERVAL 48 HOUR)", "alerts",
        extra=(("opened", "SELECT DISTINCT station_id, created_at FROM alerts WHERE status='open'"),))),
    "suppression_chain": (suppression_chain, with_entities(
        "SELECT q.id, q.station_id, epoch_us(q.created_at) AS ts_us, severity FROM alerts q JOIN (SELECT station_id, ts, min(id) AS id"
        " FROM alerts JOIN passed USING (station_id) WHERE created_at=ts GROUP BY ALL) k ON k.id=q.id", "alerts", extra=(
            ("passed", "SELECT station_id, min(created_at) AS ts FROM alerts GROUP BY 1 UNION ALL SELECT p.station_id,"
             " (SELECT min(created_at) FROM alerts a WHERE a.station_id=p.station_id AND a.created_at >= p.ts + INTERVAL 48 HOUR)"
             " FROM passed p WHERE p.ts IS NOT NULL"),
        ))),
    "event_contrast": (event_contrast, with_entities(
        "SELECT a.id, a.etype, a.station_id, c.indicator, round(before+1e-9,4) AS before, c.after,"
        " round(c.after/c.before+1e-9,4) AS ratio FROM alerts a JOIN contrasts c ON c.station_id=a.station_id"
        " AND c.onset_ts=a.onset_ts WHERE c.after > c.before*1.3", "alerts", "readings", extra=(
            ("onsets", "SELECT DISTINCT station_id, onset_ts FROM alerts"),
            ("contrasts", "SELECT o.station_id, o.onset_ts, p.indicator, avg(p.value) FILTER (WHERE p.ts<o.onset_ts) AS before,"
             " max(p.value) FILTER (WHERE p.ts>=o.onset_ts) AS after FROM onsets o JOIN readings p ON p.station_id=o.station_id"
             " GROUP BY ALL"),
        ))),
    "baseline_summary": (baseline_summary, with_entities(
        "SELECT station_id, indicator, round(avg(value)+1e-9,4) AS avg_value, min(value) AS min_value, max(value) AS max_value"
        f" FROM readings WHERE ts < timestamp '{CUTOFF}' GROUP BY ALL", "readings")),
    "top_peaks": (top_peaks, with_entities(
        "SELECT station_id, indicator, epoch_us(ts) AS ts_us, value, rank FROM (SELECT *, row_number() OVER"
        f" ({_SERIES} ORDER BY value DESC, ts) AS rank FROM readings WHERE ts < timestamp '{CUTOFF}') WHERE rank<=5", "readings")),
    "series_slice": (series_slice, with_entities(
        f"SELECT station_id, indicator, epoch_us(ts) AS ts_us, value, count(*) OVER ({_SERIES}) AS count FROM readings"
        " WHERE ts BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-20 12:00:00'", "readings")),
    "series_stride": (series_stride, with_entities(
        f"SELECT station_id, indicator, epoch_us(ts) AS ts_us, value, count(*) OVER ({_SERIES}) AS count FROM (SELECT *,"
        f" row_number() OVER ({_SERIES} ORDER BY ts, value)-1 AS k FROM readings) WHERE k%4=0",
        "readings")),
    "series_since": (series_since, with_entities(
        f"SELECT station_id, indicator, epoch_us(ts) AS ts_us, value, k AS idx FROM (SELECT *, row_number() OVER ({_SERIES} ORDER BY ts, value)-1 AS k"
        " FROM readings WHERE ts >= timestamp '2024-01-03')", "readings")),
    "playback_heat": (playback_heat, with_entities(
        "SELECT f.indicator, epoch_us(f.onset_ts) AS onset_us, f.station_id, epoch_us(f.at) AS at_us, f.now AS value,"
        " round(CASE WHEN p.peak>0 THEN least(f.now/p.peak,1.0) ELSE 0.0 END+1e-9,4) AS heat"
        " FROM (SELECT g.*, CASE WHEN v.ts>=g.onset_ts - INTERVAL 6 HOUR THEN v.value ELSE 0.0 END AS now FROM frames g"
        " ASOF LEFT JOIN readings v ON v.station_id=g.station_id AND v.indicator=g.indicator AND v.ts<=g.at) f LEFT JOIN peaks_in p USING (indicator, onset_ts, station_id)", "alerts", "readings",
        extra=(
            ("plays", "SELECT DISTINCT indicators[1] AS indicator, onset_ts FROM alerts WHERE len(indicators)>0"),
            ("frames", "SELECT indicator, onset_ts, s.id AS station_id, unnest(generate_series(onset_ts - INTERVAL 6 HOUR,"
             " onset_ts + INTERVAL 48 HOUR, INTERVAL 1 HOUR)) AS at FROM plays, (SELECT concat('st_', lpad(cast(n_nationkey AS varchar),"
             " 2, '0')) AS id FROM nation WHERE n_nationkey%3=0) s"),
            ("peaks_in", "SELECT p.indicator, p.onset_ts, r.station_id, max(r.value) AS peak FROM plays p JOIN readings r"
             " ON r.indicator=p.indicator AND r.ts BETWEEN p.onset_ts - INTERVAL 6 HOUR AND p.onset_ts + INTERVAL 48 HOUR GROUP BY ALL"),
        ))),
    "hour_overlap": (hour_overlap, with_entities(
        "SELECT id, coalesce(string_agg(cast(h AS varchar), ',' ORDER BY h) FILTER (WHERE own),'') AS hours,"
        " round(sum(CASE WHEN own AND (h>=22 OR h<3) THEN 1 ELSE 0 END)/greatest(sum(CASE WHEN own OR h>=22 OR h<3 THEN 1 ELSE 0 END),1)"
        "+1e-9,4) AS overlap FROM (SELECT id, h, CASE WHEN hour_from<=hour_to THEN h>=hour_from AND h<hour_to"
        " ELSE h>=hour_from OR h<hour_to END AS own FROM enterprises, range(24) t(h)) GROUP BY id", "enterprises")),
    "readings_merge": (readings_merge, with_entities(
        "SELECT station_id, indicator, ts_us, coalesce(arg_max(value, event_id) FILTER (late), arg_max(value, event_id) FILTER (NOT late)) AS value"
        " FROM (SELECT concat('st_', lpad(cast(3*(user_id%9) AS varchar), 2, '0')) AS station_id, event_type AS indicator,"
        " epoch_us(date_trunc('hour', ts)) AS ts_us, value, event_id, coalesce(value>=50 AND dayofweek(ts)=1, false) AS late FROM events)"
        " GROUP BY 1,2,3")),
    "readings_upsert": (readings_upsert, with_entities(
        "SELECT concat('st_', lpad(cast(3*(user_id%9) AS varchar), 2, '0')) AS station_id, event_type AS indicator,"
        " epoch_us(date_trunc('hour', ts)) AS ts_us, arg_max(value, event_id) AS value FROM events GROUP BY 1,2,3")),
}
