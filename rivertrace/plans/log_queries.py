"""Queries on the message log, regulations, response plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.functions.text import parse_indicators
from rivertrace.operators import casefile as K
from rivertrace.plans.common import at, open_river, r
from rivertrace.plans.oracle_entities import with_entities
from rivertrace.session import scratch_path
from rivertrace.sources import stores as ST
from rivertrace.sources.tables import INDICATORS

KEYWORDS = ["thing", "SRC7", "eauler", "nowhere to be found"]
POLLUTANTS = ("cod", "ammonia", "tp", "cr6", "xyz")


def log_latest(spark, folder):
    """State of each investigation as a reader of the log sees it."""
    return K.investigation_state(open_river(spark, folder).messages).select("inv_id", "seq", "type", "item_id", r("score", 4).alias("score"))


def log_first(spark, folder):
    return K.first_per_item(open_river(spark, folder).messages).select("inv_id", "item_id", "seq", "text")


def message_guard(spark, folder):
    """Raw log lines: JSON messages, control messages and plain text; the guard keeps the first kind."""
    raw = open_river(spark, folder).messages.withColumn(
        "raw",
        F.when(F.col("seq") % 5 == 4, F.col("text")).otherwise(F.to_json(F.struct("type", F.struct("item_id", "seq").alias("data")))),
    )
    return K.guard_messages(raw).select("inv_id", "seq", "type", F.get_json_object("data", "$.item_id").alias("item_id"))


def message_replay(spark, folder):
    """Writes the log as JSON lines per investigation and reads it back."""
    path = scratch_path(spark, "log")
    log = open_river(spark, folder).messages.select("inv_id", "seq", "type", F.col("text").alias("data"), at("2024-01-01").alias("at"))
    ST.append_messages(log, path)
    return ST.read_messages(spark, path).select("inv_id", "seq", "type", "data")


def recordings(spark, folder):
    return ST.recordings(open_river(spark, folder).messages)


def keyword_search(spark, folder):
    return K.keyword_hits(open_river(spark, folder).documents, KEYWORDS).select("keyword", "pos", "indicator", "standard")


def _events(river):
    """Alerts whose indicators are named as the regulations name them."""
    names = F.create_map(*[F.lit(x) for pair in zip(INDICATORS, POLLUTANTS) for x in pair])
    listed = F.transform(parse_indicators(F.col("indicators")), lambda i: names[i])
    return river.alerts.withColumn("indicators", listed)


def compliance_text(spark, folder):
    clauses = spark.createDataFrame(V.REGULATIONS, V.REGULATION_COLUMNS)
    return K.compliance_texts(_events(open_river(spark, folder)), clauses, list(POLLUTANTS))


def response_plan(spark, folder):
    return K.response_texts(open_river(spark, folder).alerts)


def _report_lines(river):
    messages = river.messages.withColumn("item", F.col("item_id"))
    c = F.col
    events = messages.groupBy("inv_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).select(
        "inv_id", F.concat(F.lit("evt_"), "inv_id").alias("event_id"), F.lit("periodic").alias("etype"), F.lit("high").alias("severity"),
        F.lit("st_03").alias("station_id"), F.array(F.lit("cod"), F.lit("tp")).alias("indicators"),
        F.timestamp_seconds(F.lit(1_704_067_200) + c("n") * 60).alias("onset_ts"), "n",
    )
    steps = messages.where("type = 'step'").select(
        "inv_id", "seq", F.lit("证据校核").alias("phase"), c("item").alias("clue"), c("text").alias("reasoning"),
        F.array(F.struct(F.lit("seq").alias("kind"), c("seq").cast("string").alias("value"))).alias("evidence"),
    )
    suspects = messages.where("type = 'hypothesis'").select(
        "inv_id", c("seq").alias("rank"), c("item").alias("target_name"), F.lit("food").alias("industry"),
        F.bround("score", 3).alias("score"), F.lit("candidate").alias("status"),
    )
    verdicts = events.select(
        "inv_id", F.when(c("n") % 2 == 0, "resolved").otherwise("failed").alias("verdict"), F.lit("S").alias("source_name"),
        F.lit(0.98).alias("confidence"), F.lit("summary").alias("evidence_summary"), F.lit("reason").alias("reason"),
        F.array(F.lit("a"), F.lit("b")).alias("suggestions"),
    )
    talks = messages.where("type = 'agent_talk'").select("inv_id", "seq", c("item").alias("agent"), "text")
    return K.report_lines(events, steps, suspects, verdicts, talks)


def report_text(spark, folder):
    return K.report_texts(_report_lines(open_river(spark, folder))).select("inv_id", "text")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


_NUMBERED = {k: "\n".join(f"{i}. {s}" for i, s in enumerate(v, start=1)) for k, v in V.RESPONSE_STEPS.items()}
_CLAUSES = "SELECT * FROM (VALUES " + ",".join(
    f"({p},{_sql_text(s)},{_sql_text(c)},{_sql_text(i)},{_sql_text(t)})" for p, s, c, i, _, _, t in V.REGULATIONS
) + ") t(pos,standard,clause,indicator,text)"
_LINE = "'- '||standard||' · '||clause||'：'||text"
_RENAME = "CASE x WHEN 'click' THEN 'cod' WHEN 'error' THEN 'ammonia' WHEN 'purchase' THEN 'tp' WHEN 'signup' THEN 'cr6' ELSE 'xyz' END"
_L = V.REPORT
_REPORT = (
    ("ev", "SELECT inv_id, count(*) AS n FROM messages GROUP BY 1"),
    ("steps", "SELECT inv_id, string_agg('### '||k||'. 证据校核'||chr(10)||" + _sql_text(_L["clue"]) + "||item_id||chr(10)||"
     + _sql_text(_L["reasoning"]) + "||text||chr(10)||" + _sql_text(_L["evidence"]) + "||'seq = '||seq||chr(10)||chr(10), '' ORDER BY seq) AS t"
     " FROM (SELECT *, row_number() OVER (PARTITION BY inv_id ORDER BY seq) AS k FROM messages WHERE type='step') GROUP BY 1"),
    ("susp", "SELECT inv_id, string_agg('- '||item_id||'（food）：得分 '||cast(round_even(score,3) AS varchar)||'，状态 candidate'||chr(10), ''"
     " ORDER BY round_even(score,3) DESC, seq) AS t FROM messages WHERE type='hypothesis' GROUP BY 1"),
    ("talk", "SELECT inv_id, string_agg('**'||item_id||'**：'||text||chr(10), chr(10) ORDER BY seq) AS t FROM messages"
     " WHERE type='agent_talk' GROUP BY 1"),
)
_REPORT_SQL = (
    "SELECT e.inv_id, " + _sql_text(_L["title"]) + "||chr(10)||chr(10)||" + _sql_text(_L["investigation"])
    + "||e.inv_id||chr(10)||" + _sql_text(_L["event"]) + "||'evt_'||e.inv_id||'（periodic / high）'||chr(10)||" + _sql_text(_L["station"])
    + "||'st_03'||chr(10)||" + _sql_text(_L["indicators"]) + "||'cod, tp'||chr(10)||" + _sql_text(_L["onset"])
    + "||strftime(timestamp '2024-01-01'+to_minutes(cast(n AS int)), '%Y-%m-%d %H:%M')||' UTC'||chr(10)||chr(10)||" + _sql_text(_L["steps"])
    + "||chr(10)||chr(10)||coalesce(s.t,'')||" + _sql_text(_L["suspects"]) + "||chr(10)||chr(10)||coalesce(u.t,'')||chr(10)||"
    + _sql_text(_L["conclusion"]) + "||chr(10)||chr(10)||CASE WHEN n%2=0 THEN " + _sql_text(_L["locked"]) + "||'S**'||chr(10)||chr(10)||"
    + _sql_text(_L["confidence"]) + "||'98%'||chr(10)||" + _sql_text(_L["basis"]) + "||'summary' ELSE " + _sql_text(_L["not_locked"])
    + "||chr(10)||chr(10)||" + _sql_text(_L["reason"]) + "||'reason'||chr(10)||" + _sql_text(_L["advice"]) + "||'a；b' END||chr(10)||chr(10)||"
    + _sql_text(_L["opinions"]) + "||chr(10)||coalesce(chr(10)||t.t, '') AS text FROM ev e LEFT JOIN steps s ON s.inv_id=e.inv_id"
    " LEFT JOIN susp u ON u.inv_id=e.inv_id LEFT JOIN talk t ON t.inv_id=e.inv_id"
)

QUERIES = {
    "log_latest": (log_latest, with_entities(
        "SELECT inv_id, seq, type, item_id, round(score+1e-9,4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY inv_id, type, item_id"
        " ORDER BY seq) AS a, row_number() OVER (PARTITION BY inv_id, type, item_id ORDER BY seq DESC) AS z FROM messages)"
        " WHERE (type='step' AND a=1) OR type='agent_talk' OR (type='hypothesis' AND z=1)", "messages")),
    "log_first": (log_first, with_entities(
        "SELECT inv_id, item_id, min(seq) AS seq, arg_min(text, seq) AS text FROM messages WHERE type='step' GROUP BY 1,2", "messages")),
    "message_guard": (message_guard, with_entities(
        "SELECT inv_id, seq, type, item_id FROM messages WHERE seq%5<>4 AND type<>'connected'", "messages")),
    "message_replay": (message_replay, with_entities("SELECT inv_id, seq, type, text AS data FROM messages", "messages")),
    "recordings": (recordings, with_entities("SELECT DISTINCT inv_id FROM messages", "messages")),
    "keyword_search": (keyword_search, "WITH k AS (SELECT unnest(['thing','SRC7','eauler','nowhere to be found']) AS keyword),"
        " h AS (SELECT keyword, doc_id AS pos, lang AS indicator, source AS standard FROM documents, k WHERE contains(lower(lang), lower(keyword))"
        " OR contains(lower(source), lower(keyword)) OR contains('c'||n_chars, lower(keyword)) OR contains(lower(text), lower(keyword)))"
        " SELECT * FROM h UNION ALL SELECT keyword, doc_id, lang, source FROM documents, k WHERE keyword NOT IN (SELECT keyword FROM h)"),
    "compliance_text": (compliance_text, with_entities(
        f"SELECT a.id, {_sql_text(V.COMPLIANCE_HEAD)}||chr(10)||coalesce(o.lines, (SELECT string_agg({_LINE}, chr(10) ORDER BY pos) FROM"
        " clauses WHERE indicator='general' AND pos<7))||chr(10)||chr(10)||" + _sql_text(V.COMPLIANCE_TAIL) + " AS text FROM alerts a LEFT JOIN"
        f" (SELECT id, string_agg({_LINE}, chr(10) ORDER BY k) AS lines FROM (SELECT id, unnest(indicators) AS x, generate_subscripts(indicators,1)"
        f" AS k FROM alerts) JOIN clauses ON indicator={_RENAME} GROUP BY id) o ON o.id=a.id", "alerts", extra=(("clauses", _CLAUSES),))),
    "response_plan": (response_plan, with_entities(
        "SELECT id, '建议处置方案（'||etype||' · '||severity||'）：'||chr(10)||CASE etype "
        + " ".join(f"WHEN '{k}' THEN {_sql_text(t)}" for k, t in _NUMBERED.items())
        + " END||chr(10)||chr(10)||'优先级提示：'||CASE severity "
        + " ".join(f"WHEN '{k}' THEN {_sql_text(t)}" for k, t in V.SEVERITY_ADVICE.items())
        + " END AS text FROM alerts", "alerts")),
    "report_text": (report_text, with_entities(_REPORT_SQL, "messages", extra=_REPORT)),
}
