"""The investigation's own log: its messages, the status changes that follow, and an audit of such changes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.operators.blocks import DAY, not_null, time_block
from rivertrace.session import write_once

# The batch functions below travel to the workers by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Status changes that are allowed, and the status before the first change.
EVENT_CHANGES = {("open", "investigating"), ("investigating", "resolved"), ("investigating", "open")}
INVESTIGATION_CHANGES = {("new", "running"), ("running", "resolved"), ("running", "failed")}
EVENT_FIRST, INVESTIGATION_FIRST = "open", "new"

# Places in the log: opening, hypotheses as proposed, a stretch of ROUND per verified hypothesis, the outcome.
PROPOSED, ROUND, OUTCOME = 10, 100, 1000


def _message(seq: Column, kind: str, item: Column, target: Column, score: Column, status: Column, text: Column) -> Column:
    return F.struct(
        seq.cast("bigint").alias("seq"), F.lit(kind).alias("type"), item.cast("string").alias("item_id"),
        target.cast("string").alias("target"), score.cast("double").alias("score"), status.cast("string").alias("status"),
        text.cast("string").alias("text"),
    )


def investigation_messages(events: DataFrame, verified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(inv_id, seq, type, item_id, target, score, status, text): everything an investigation of each alert says.

    ``events`` has id, station_id, indicators (array), etype, severity; ``verified`` and ``verdicts`` come from the attribution.
    An opening step, each hypothesis as proposed, a step per piece of evidence, a step for a hypothesis that is
    dropped, the hypothesis as verified, then conclusion or failed, and report_ready. The place in the log follows from
    the kind of message and the rank of its hypothesis, so nothing is sorted or joined here. An alert without
    candidates has opening and outcome only; null texts stay null.
    """
    c, none = F.col, F.lit(None)
    opening = events.select(
        c("id").cast("string").alias("inv_id"),
        _message(F.lit(0), "step", F.lit("parse"), c("station_id"), none, F.lit("verified"),
                 F.array_join("indicators", ", ")).alias("m"),
    )
    base = c("rank") * ROUND
    said = [_message(PROPOSED + c("rank"), "hypothesis", c("hypothesis"), c("name"), c("prior"), F.lit("candidate"), none)]
    for place, kind in enumerate(V.EVIDENCE_WEIGHTS):
        step = _message(base + place, "step", F.concat("hypothesis", F.lit("_" + kind)), c("name"), c(kind), F.lit("verified"), none)
        said.append(F.when(c(kind).isNotNull(), step))
    dropped = F.concat("name", F.lit(" 综合得分 "), c("score").cast("string"), F.lit(" 低于阈值"))
    said.append(F.when(
        c("status") == "rejected",
        _message(base + 8, "step", F.concat("hypothesis", F.lit("_drop")), c("name"), c("score"), F.lit("rejected"), dropped)))
    said.append(_message(base + 9, "hypothesis", c("hypothesis"), c("name"), c("score"), c("status"), none))
    body = verified.select(
        c("event_id").cast("string").alias("inv_id"),
        F.explode(F.filter(F.array(*said), lambda m: m.isNotNull())).alias("m"),
    )
    outcome = F.when(
        c("verdict") == "resolved",
        _message(F.lit(OUTCOME), "conclusion", none, c("source_name"), c("confidence"), c("verdict"), c("evidence_summary")),
    ).otherwise(_message(F.lit(OUTCOME), "failed", none, none, c("confidence"), c("verdict"), c("reason")))
    ready = _message(F.lit(OUTCOME + 1), "report_ready", none, none, none, none, c("event_id"))
    ending = verdicts.select(c("event_id").cast("string").alias("inv_id"), F.explode(F.array(outcome, ready)).alias("m"))
    return opening.unionByName(body).unionByName(ending).select("inv_id", "m.*")


def outcome_changes(messages: DataFrame, started: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status changes (id, change, status, at) of the investigations and of their alerts, as the log tells them.

    ``started`` has inv_id and ``at``. Both start with the investigation; its outcome, a second after for each place in
    the log, settles the investigation as resolved or failed and the alert as resolved or open again.
    """
    last = messages.where(F.col("type").isin("conclusion", "failed")).groupBy("inv_id").agg(F.max_by("status", "seq").alias("verdict"))
    # Both logs start from the outcomes, so these are written once.
    known = write_once(started.join(last, "inv_id", "left").select(F.col("inv_id").alias("id"), "at", "verdict"), "outcomes")

    def changes(running: str, failed: str) -> DataFrame:
        after = F.when(F.col("verdict") == "resolved", F.lit("resolved")).otherwise(failed)
        begun = F.struct(F.lit(0).alias("change"), F.lit(running).alias("status"), F.col("at"))
        ended = F.struct(
            F.lit(1).alias("change"), after.alias("status"), (F.col("at") + F.make_dt_interval(secs=F.lit(OUTCOME))).alias("at"))
        both = F.when(F.col("verdict").isNull(), F.array(begun)).otherwise(F.array(begun, ended))
        return known.select("id", F.explode(both).alias("c")).select("id", "c.*")

    return changes("running", "failed"), changes("investigating", "open")


def _block_maps(states: list[str], allowed: set[tuple[str, str]]):
    """What a block of changes makes of every status it may be entered with; rows come sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, start = None, None, tuple(states)
        after = {}  # the few steps there are from one such map to the next
        for part in batches:
            ids, blocks, ends = [], [], []
            for own, status in zip(zip(part["id"], part["block"]), part["status"]):
                if own != key:
                    if key is not None:
                        ids.append(key[0]), blocks.append(key[1]), ends.append(list(now))
                    key, now = own, start
                step = now, status
                if step not in after:
                    after[step] = tuple(status if (s, status) in allowed else s for s in now)
                now = after[step]
            if ids:
                yield pd.DataFrame({"id": ids, "block": blocks, "ends": ends})
        if key is not None:
            yield pd.DataFrame({"id": [key[0]], "block": [key[1]], "ends": [list(now)]})

    return run


def _entries(states: list[str], first: str):
    """The status each block is entered with; the blocks of an id come in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, first
        for part in batches:
            entry = []
            for own, ends in zip(part["id"], part["ends"]):
                if own != key:
                    key, now = own, first
                entry.append(now)
                now = ends[states.index(now)]
            yield part[["id", "block"]].assign(entry=entry)

    return run


def _replayed(allowed: set[tuple[str, str]]):
    """Status before and after every change of a block; rows come sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, None
        for part in batches:
            before, after = [], []
            for own, entry, status in zip(zip(part["id"], part["block"]), part["entry"], part["status"]):
                if own != key:
                    key, now = own, entry
                before.append(now)
                now = status if (now, status) in allowed else now
                after.append(now)
            yield part.drop(columns=["block", "entry"]).assign(before=before, after=after)

    return run


def audit_changes(
    log: DataFrame, allowed: set[tuple[str, str]] = EVENT_CHANGES, first: str = EVENT_FIRST, block_seconds: int = DAY
) -> DataFrame:
    """Replays status changes (id, change, status, at): adds ``before``, ``after`` and ``outcome`` to every row.

    A change counts if it is allowed from the status the id is in (``moved``); naming that status again is ``repeated``,
    anything else ``refused``, and neither changes it. Rows go by time, then by ``change``, then by status. Rows without id or
    time have no place and are left out; a null or unknown status is refused.

    Whether a change counts depends on all before it, yet no id is ordered in one task: a block of time is a map from the
    status it is entered with to the one it ends with, maps are composed over the table of blocks, and each block is
    then replayed from its own entry. Rows stream through sorted partitions; no block is gathered.
    """
    states = sorted({first, *[s for pair in allowed for s in pair]})
    id_type, change_type = (log.schema[c].dataType.simpleString() for c in ("id", "change"))
    rows = write_once(
        log.where(not_null("id", "at")).select("id", "change", "status", "at", time_block("at", block_seconds).alias("block")),
        "changes",
    )
    order = ("id", "block", "at", "change", "status")
    maps = (
        rows.repartition("id", "block").sortWithinPartitions(*order)
        .mapInPandas(_block_maps(states, allowed), f"id {id_type}, block bigint, ends array<string>")
    )
    entries = (
        maps.repartition("id").sortWithinPartitions("id", "block")
        .mapInPandas(_entries(states, first), f"id {id_type}, block bigint, entry string")
    )
    replayed = (
        rows.join(entries, ["id", "block"]).select("id", "block", "change", "status", "at", "entry")
        .repartition("id", "block").sortWithinPartitions(*order)
        .mapInPandas(
            _replayed(allowed),
            f"id {id_type}, change {change_type}, status string, at timestamp, before string, after string",
        )
    )
    outcome = F.when(F.col("before") != F.col("after"), "moved").when(F.col("before") == F.col("status"), "repeated")
    return replayed.withColumn("outcome", outcome.otherwise("refused"))
