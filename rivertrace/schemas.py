"""Explicit schemas of the eight stored tables and the message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id STRING, name STRING, kind STRING, x DOUBLE, y DOUBLE, flow DOUBLE, velocity DOUBLE, k DOUBLE"
EDGES = "from_node STRING, to_node STRING, distance_m DOUBLE"
STATIONS = "id STRING, node_id STRING, interval_min INT, indicators ARRAY<STRING>"
DISCHARGE_PATTERN = (
    "continuous BOOLEAN, active_hours ARRAY<INT>, night_boost DOUBLE, night_window ARRAY<INT>, "
    "weekend_scale DOUBLE, seasonal_amp DOUBLE, event_only BOOLEAN, q_waste DOUBLE, treat_rate DOUBLE"
)
ENTERPRISES = (
    f"id STRING, name STRING, industry STRING, node_id STRING, discharge_pattern STRUCT<{DISCHARGE_PATTERN}>"
)
SPECTRUM = "ARRAY<STRUCT<lex: DOUBLE, lem: DOUBLE, amp: DOUBLE, sigma: DOUBLE>>"
FINGERPRINTS = f"enterprise_id STRING, spectrum {SPECTRUM}, pollutants MAP<STRING, DOUBLE>"
READINGS = "station_id STRING, ts TIMESTAMP, indicator STRING, value DOUBLE"
EVENTS = (
    "id STRING, station_id STRING, indicators ARRAY<STRING>, onset_ts TIMESTAMP, severity STRING, "
    "etype STRING, truth_source STRING, status STRING"
)
CONCLUSION = (
    "source_id STRING, source_name STRING, industry STRING, confidence DOUBLE, status STRING, "
    "evidence_summary STRING, reason STRING, suggestions ARRAY<STRING>"
)
INVESTIGATIONS = (
    f"id STRING, event_id STRING, started_at TIMESTAMP, conclusion STRUCT<{CONCLUSION}>, status STRING"
)
NETWORK_DOCUMENT = (
    f"nodes ARRAY<STRUCT<{NODES}>>, edges ARRAY<STRUCT<{EDGES}>>, stations ARRAY<STRUCT<{STATIONS}>>, "
    f"enterprises ARRAY<STRUCT<{ENTERPRISES}>>, fingerprints ARRAY<STRUCT<{FINGERPRINTS}>>"
)
INDUSTRY_PROFILE = f"label STRING, peaks {SPECTRUM}, outfall_conc MAP<STRING, DOUBLE>"
MESSAGE = "inv_id STRING, seq BIGINT, at TIMESTAMP, type STRING, data STRING"

# The enumerations the tables may hold.
NODE_KINDS = ("source", "segment", "confluence", "outlet")
SEVERITIES = ("low", "medium", "high")
EVENT_TYPES = ("sudden", "periodic", "gradual", "detected")
EVENT_STATUSES = ("open", "investigating", "resolved")
INVESTIGATION_STATUSES = ("running", "resolved", "failed")
MESSAGE_TYPES = ("step", "hypothesis", "agent_talk", "conclusion", "failed", "report_ready")


def invalid_rows(df: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose enumerated columns hold a value outside the allowed set."""
    bad: Column = F.lit(False)
    for column, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.where(bad)
