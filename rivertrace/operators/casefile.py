"""Message log reductions, regulation search, compliance and response texts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.functions.text import guarded_type
from rivertrace.functions.timeparts import format_utc, percent
from rivertrace.operators.blocks import with_positions

SEARCHED = ("indicator", "standard", "clause", "text")
HITS_PER_INDICATOR = 2  # fixed value: search hits looked at per indicator
GENERAL = "general"  # fixed value: keyword of the general clauses


def guard_messages(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Rows whose text is a JSON message of an allowed type, with ``type`` and ``data`` (JSON)."""
    return (
        raw.withColumn("type", guarded_type(F.col(column)))
        .where("type IS NOT NULL")
        .withColumn("data", F.get_json_object(column, "$.data"))
    )


def _one_per(rows: DataFrame, keys: list[str], pick: Callable[..., Column], **known: str) -> DataFrame:
    """One row per key, chosen by ``seq``. What the key or ``known`` (columns of one value) tells does not travel again beside it."""
    rest = F.struct(*[c for c in rows.columns if c not in keys and c not in known])
    found = rows.groupBy(*keys).agg(pick(rest, "seq").alias("_row"))
    own = {c: F.col(c) for c in keys} | {c: F.lit(v) for c, v in known.items()}
    return found.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in rows.columns])


def first_per_item(messages: DataFrame, kind: str = "step", item: str = "item_id") -> DataFrame:
    """Keeps the first message of each item: replays after a reconnect add nothing."""
    return _one_per(messages.where(F.col("type") == kind), ["inv_id", item], F.min_by, type=kind)


def last_per_item(messages: DataFrame, kind: str = "hypothesis", item: str = "item_id") -> DataFrame:
    """Keeps the last message of each item: later scores overwrite earlier ones."""
    return _one_per(messages.where(F.col("type") == kind), ["inv_id", item], F.max_by, type=kind)


def last_per_type(messages: DataFrame, kinds: tuple[str, ...] = ("conclusion", "failed", "report_ready")) -> DataFrame:
    """The last message of each single-valued type per investigation."""
    return _one_per(messages.where(F.col("type").isin(*kinds)), ["inv_id", "type"], F.max_by)


def investigation_state(messages: DataFrame) -> DataFrame:
    """What a reader of the log sees: first steps, all talks, last hypotheses, last single-valued messages."""
    talks = messages.where(F.col("type") == "agent_talk")
    return (
        first_per_item(messages).unionByName(talks).unionByName(last_per_item(messages)).unionByName(last_per_type(messages))
    )


def keyword_hits(clauses: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, clause columns) for case-insensitive substring hits; every clause for a keyword without any.

    Keywords are a short argument list; clauses are scanned once and not joined to them.
    """
    wanted = F.array(*[F.lit(k) for k in keywords])
    lowered = [F.lower(F.col(c)) for c in SEARCHED]

    def matches(keyword: Column) -> Column:
        found = F.lit(False)
        for text in lowered:
            found = found | F.coalesce(text.contains(F.lower(keyword)), F.lit(False))
        return found

    hits = clauses.withColumn("keyword", F.explode(F.filter(wanted, matches)))
    known = hits.agg(F.collect_set("keyword").alias("k")).scalar()
    return hits.unionByName(clauses.withColumn("keyword", F.explode(F.array_except(wanted, known))))


def clauses_for(clauses: DataFrame, keywords: list[str], count: int = HITS_PER_INDICATOR) -> DataFrame:
    """The first hits per keyword, cut before asking whether a hit is about the keyword itself.

    ``clauses`` carries its order in ``pos``. The window group limit cuts each partition to ``count``.
    """
    order = Window.partitionBy("keyword").orderBy("pos")
    first = (
        keyword_hits(clauses, keywords).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    )
    return first.where(F.col("indicator") == F.col("keyword"))


def clause_line() -> Column:
    return F.concat(F.lit("- "), "standard", F.lit(" · "), "clause", F.lit("："), "text")


def compliance_texts(events: DataFrame, clauses: DataFrame, indicators: list[str]) -> DataFrame:
    """One compliance text per event from the clauses of its indicators, the general ones if there are none.

    Clauses are chosen once per indicator; events (with an ``indicators`` array) only look them up.
    """
    own = clauses_for(clauses, indicators).select("keyword", "rank", clause_line().alias("line"))
    per_indicator = own.groupBy(F.col("keyword").alias("indicator")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda c: c["line"]).alias("lines")
    )
    order = Window.partitionBy("keyword").orderBy("pos")
    general = (
        keyword_hits(clauses, [GENERAL])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= HITS_PER_INDICATOR)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", clause_line().alias("line")))), lambda c: c["line"]
            ).alias("lines")
        )
        .scalar()
    )
    named = (
        events.select("id", F.posexplode("indicators").alias("pos", "indicator"))
        .join(per_indicator, "indicator")
        .groupBy("id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda c: c["lines"])).alias("lines"))
    )
    lines = F.array_join(F.coalesce("lines", general), "\n")
    text = F.concat(F.lit(V.COMPLIANCE_HEAD + "\n"), lines, F.lit("\n\n" + V.COMPLIANCE_TAIL))
    return events.select("id").join(named, "id", "left").select("id", text.alias("text"))


def response_texts(events: DataFrame) -> DataFrame:
    """Response plan per event by type (default: detected) and severity. A constant lookup, no join."""
    def entries(source: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in source.items() for x in pair])

    plans = {
        kind: "\n".join(f"{i}. {step}" for i, step in enumerate(steps, start=1))
        for kind, steps in V.RESPONSE_STEPS.items()
    }
    etype, severity = F.coalesce("etype", F.lit("detected")), F.coalesce("severity", F.lit("medium"))
    steps = F.coalesce(F.try_element_at(entries(plans), etype), F.lit(plans["detected"]))
    advice = F.try_element_at(entries(V.SEVERITY_ADVICE), severity)
    text = F.concat(
        F.lit("建议处置方案（"), etype, F.lit(" · "), severity, F.lit("）：\n"), steps, F.lit("\n\n优先级提示："), advice
    )
    return events.select("id", text.alias("text"))


def report_lines(
    events: DataFrame, steps: DataFrame, hypotheses: DataFrame, verdicts: DataFrame, talks: DataFrame
) -> DataFrame:
    """(inv_id, section, lead, item, part, line): the report of every investigation as ordered lines.

    Inputs keyed by ``inv_id``: events (event_id, etype, severity, station_id, indicators, onset_ts),
    steps (seq, phase, clue, reasoning, evidence array of kind/value), hypotheses (rank, target_name,
    industry, score, status), verdicts (verdict, source_name, confidence, evidence_summary, reason, suggestions),
    talks (seq, agent, text). Lines stay rows: no investigation is gathered to build them.
    """
    L = V.REPORT

    def lines(rows: DataFrame, section: int, item: Column, *parts: Column, lead: Column | None = None) -> DataFrame:
        """``lead`` orders the items of a section before their number; a title has none and comes first."""
        return rows.select(
            "inv_id", F.lit(section).alias("section"), (F.lit(0.0) if lead is None else lead).cast("double").alias("lead"),
            item.cast("bigint").alias("item"),
            F.posexplode(F.flatten(F.array(*parts))).alias("part", "line"),
        )

    def one(*pieces) -> Column:
        return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]))

    c = F.col
    head = lines(
        events, 0, F.lit(0),
        one(L["title"]), one(""), one(L["investigation"], c("inv_id")),
        one(L["event"], c("event_id"), "（", c("etype"), " / ", c("severity"), "）"),
        one(L["station"], c("station_id")), one(L["indicators"], F.array_join("indicators", ", ")),
        one(L["onset"], format_utc(c("onset_ts"))), one(""), one(L["steps"]), one(""),
    )
    numbered = with_positions(steps, keys=["inv_id"], order="seq", block=F.floor(c("seq") / 4096))
    body = lines(
        numbered, 1, c("idx"),
        one("### ", (c("idx") + 1).cast("string"), ". ", c("phase")), one(L["clue"], c("clue")),
        one(L["reasoning"], c("reasoning")),
        F.transform("evidence", lambda e: F.concat(F.lit(L["evidence"]), e["kind"], F.lit(" = "), e["value"])),
        one(""),
    )
    title2 = lines(events, 2, F.lit(-1), one(L["suspects"]), one(""), lead=F.lit(None))
    suspects = lines(
        hypotheses, 2, c("rank"),
        one("- ", c("target_name"), "（", c("industry"), "）：得分 ", c("score").cast("string"), "，状态 ", c("status")), lead=-c("score"),
    )
    title3 = lines(events, 3, F.lit(-1), one(""), one(L["conclusion"]), one(""))
    ending = lines(
        verdicts, 3, F.lit(0),
        F.when(
            c("verdict") == "resolved",
            F.flatten(F.array(one(L["locked"], c("source_name"), "**"), one(""), one(L["confidence"], percent(c("confidence"))),
                              one(L["basis"], c("evidence_summary")))),
        ).otherwise(
            F.flatten(F.array(one(L["not_locked"]), one(""), one(L["reason"], c("reason")),
                              one(L["advice"], F.array_join("suggestions", "；"))))
        ),
    )
    title4 = lines(events, 4, F.lit(-1), one(""), one(L["opinions"]), one(""))
    opinions = lines(talks, 4, c("seq"), one("**", c("agent"), "**：", c("text")), one(""))
    result = head
    for part in (body, title2, suspects, title3, ending, title4, opinions):
        result = result.unionByName(part)
    return result


def report_texts(lines: DataFrame) -> DataFrame:
    """Reports as text: (inv_id, text). The stored form is ``report_lines``; this gathers the lines of each
    report and is meant for reports that are read as a whole."""
    line = F.struct("section", "lead", "item", "part", "line")
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return lines.groupBy("inv_id").agg(F.array_join(ordered, "\n").alias("text"))
