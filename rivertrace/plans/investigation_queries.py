"""Queries on the investigations of all alerts: their log, what a reader sees of it, and the status changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivertrace.operators import casefile as K
from rivertrace.operators import investigation as L
from rivertrace.operators.attribution import conclude
from rivertrace.operators.blocks import suggest_block_seconds
from rivertrace.plans.attribution_queries import _EVIDENCE, _NEEDS, alerts_with_samples, verified_of
from rivertrace.plans.common import open_river
from rivertrace.plans.oracle_entities import with_entities
from rivertrace.session import write_once


def messages_of(river):
    verified = write_once(verified_of(river), "verified")
    events = alerts_with_samples(river)
    verdicts = conclude(events.select("id", "station_id", "etype"), verified)
    return L.investigation_messages(events, verified, verdicts)


def investigation_log(spark, folder):
    return messages_of(open_river(spark, folder))


def investigation_view(spark, folder):
    """The log delivered twice, as after a reconnect, and reduced to what its reader keeps."""
    log = write_once(messages_of(open_river(spark, folder)), "messages")
    # Both deliveries out of one scan, so that the reader's partial aggregates meet them before they are shuffled.
    seen = log.withColumn("seq", F.explode(F.array(F.col("seq"), F.col("seq") + 10 * L.OUTCOME)))
    return K.investigation_state(seen).select("inv_id", "type", "item_id", "target", "score", "status", "text")


def event_life_cycle(spark, folder):
    """Where every investigation and its alert end, each change checked against the status before it."""
    river = open_river(spark, folder)
    started = river.alerts.select(F.col("id").cast("string").alias("inv_id"), F.col("onset_ts").alias("at"))
    runs, alerts = L.outcome_changes(messages_of(river), started)
    seen = [
        L.audit_changes(runs, L.INVESTIGATION_CHANGES, L.INVESTIGATION_FIRST).withColumn("subject", F.lit("investigation")),
        L.audit_changes(alerts).withColumn("subject", F.lit("event")),
    ]
    return seen[0].unionByName(seen[1]).select("subject", "id", "change", "before", "after", "outcome")


def status_audit(spark, folder):
    """Status changes as reporters entered them, replayed in order: most are not allowed from where things stand."""
    alerts = open_river(spark, folder).alerts
    log = alerts.select(F.col("reporter").alias("id"), F.col("id").alias("change"), "status", F.col("created_at").alias("at"))
    seconds = suggest_block_seconds(log.withColumnRenamed("at", "ts"), keys=("id",))
    return L.audit_changes(log, block_seconds=seconds).select("id", "change", "status", "before", "after", "outcome")


_NULL = "NULL::varchar"
_LOG = (
    *_EVIDENCE,
    ("log", "SELECT id::varchar AS inv_id, 0::bigint AS seq, 'step' AS type, 'parse' AS item_id, station_id AS target, NULL::double AS score,"
     " 'verified' AS status, array_to_string(indicators, ', ') AS text FROM alerts"
     f" UNION ALL SELECT event_id::varchar, 10+rank, 'hypothesis', hypothesis, name, prior, 'candidate', {_NULL} FROM scored"
     + "".join(
         f" UNION ALL SELECT event_id::varchar, 100*rank+{k}, 'step', hypothesis||'_{kind}', name, {kind}, 'verified', {_NULL}"
         f" FROM scored WHERE {kind} IS NOT NULL" for k, kind in enumerate(("eem", "pollutant", "pattern", "strength")))
     + " UNION ALL SELECT event_id::varchar, 100*rank+8, 'step', hypothesis||'_drop', name, score, 'rejected',"
     " name||' 综合得分 '||score||' 低于阈值' FROM scored WHERE score<0.3"
     " UNION ALL SELECT event_id::varchar, 100*rank+9, 'hypothesis', hypothesis, name, score,"
     f" CASE WHEN score<0.3 THEN 'rejected' ELSE 'candidate' END, {_NULL} FROM scored"
     " UNION ALL SELECT v.event_id::varchar, 1000, CASE WHEN ok THEN 'conclusion' ELSE 'failed' END, NULL, CASE WHEN ok THEN name END,"
     " CASE WHEN ok THEN v.score ELSE 0 END, CASE WHEN ok THEN 'resolved' ELSE 'failed' END, CASE WHEN ok THEN"
     " concat('综合 EEM 指纹、污染物谱、排放规律等 ', cnt, ' 项证据，锁定 ', name, '（置信度 ', cast(round_even(v.score*100,0) AS int), '%）')"
     " WHEN has_hyp THEN '所有候选企业综合得分均低于锁定阈值（指纹匹配度不足）' ELSE '该断面上游未发现注册企业' END FROM verdicts v"
     " UNION ALL SELECT id::varchar, 1001, 'report_ready', NULL, NULL, NULL, NULL, id::varchar FROM alerts"),
)
_ALLOWED = "(VALUES ('open','investigating'), ('investigating','resolved'), ('investigating','open')) t(a, b)"
_WALK = (
    "WITH RECURSIVE numbered AS (SELECT reporter AS id, id AS change, status, row_number() OVER (PARTITION BY reporter ORDER BY created_at,"
    " id) AS k FROM alerts), walk AS (SELECT id, 0::bigint AS change, ''::varchar AS status, 0::bigint AS k, ''::varchar AS before,"
    " 'open'::varchar AS after FROM (SELECT DISTINCT reporter AS id FROM alerts) UNION ALL SELECT n.id, n.change, n.status, n.k, w.after,"
    f" CASE WHEN (w.after, n.status) IN (SELECT (a, b) FROM {_ALLOWED}) THEN n.status ELSE w.after END FROM walk w JOIN numbered n"
    " ON n.id=w.id AND n.k=w.k+1) SELECT id, change, status, before, after FROM walk WHERE k>0"
)

QUERIES = {
    "investigation_log": (investigation_log, with_entities("SELECT * FROM log", *_NEEDS, extra=_LOG)),
    "investigation_view": (investigation_view, with_entities(
        "SELECT inv_id, type, item_id, target, score, status, text FROM (SELECT *, row_number() OVER (PARTITION BY inv_id, type, item_id"
        " ORDER BY seq DESC) AS z FROM log) WHERE type<>'hypothesis' OR z=1", *_NEEDS, extra=_LOG)),
    "event_life_cycle": (event_life_cycle, with_entities(
        "SELECT 'investigation' AS subject, id::varchar AS id, 0 AS change, 'new' AS before, 'running' AS after, 'moved' AS outcome FROM alerts"
        " UNION ALL SELECT 'investigation', event_id::varchar, 1, 'running', CASE WHEN ok THEN 'resolved' ELSE 'failed' END, 'moved' FROM verdicts"
        " UNION ALL SELECT 'event', id::varchar, 0, 'open', 'investigating', 'moved' FROM alerts"
        " UNION ALL SELECT 'event', event_id::varchar, 1, 'investigating', CASE WHEN ok THEN 'resolved' ELSE 'open' END, 'moved' FROM verdicts",
        *_NEEDS, extra=_EVIDENCE)),
    "status_audit": (status_audit, with_entities(
        "SELECT *, CASE WHEN before<>after THEN 'moved' WHEN before=status THEN 'repeated' ELSE 'refused' END AS outcome"
        f" FROM ({_WALK})", "alerts")),
}
