"""Conversation structure repair: the cheapest edits of each conversation by iterative-deepening A*."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELETE, INSERT, KEEP, REROLE = "DIKR"  # in ASCII order
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Where a conversation stands after a row: before any, after the system's, the user's, the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place after each initial that may follow, and the place and role an edit leads to.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEADS = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SEEN = re.compile("[^\x20\x09-\x0d]")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text): blank, seen earlier, or without a final stop."""
    found: list[str | None] = []
    seen = set()
    for role, text in rows:
        if not SEEN.search(text):
            found.append(BLANK)
        elif (role, text) in seen:
            found.append(DUPLICATE)
        else:
            found.append(None if text.rstrip(SPACE)[-1] in ".!?" else TRUNCATED)
        seen.add((role, text))
    return found


def bounds(initials: list[str], forced: list[bool], extra: list[int]) -> list[tuple[int, int, int, int]]:
    """For each row and place a cost that no repair from there on goes below.

    A row that must go costs 3 and a truncated one at least 1. Of the others, each two neighbours that may not
    follow each other need an edit between them or on one of them, and an edit, of 2 or more besides, is at two such
    pairs at most: so does an unfit last row, and the first against the place. A chain of k such pairs then
    needs k/2 edits, rounded up.
    """
    n = len(initials)
    out = [(0, 0, 0, 0)] * (n + 1)
    after, sums, chain, chains = "", 0, 0, 0
    for i in range(n, -1, -1):
        if i < n:
            if forced[i]:
                sums += COST[DELETE]
            else:
                at = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initials[i])
                fits = at is not None and (after in FOLLOWS[at] if after else at == ASSISTANT)
                chain = 0 if fits else chain + 1
                chains += chain % 2
                sums += extra[i]
                after = initials[i] or "\0"
        met = [(after in FOLLOWS[q] if after else q in ENDS) for q in range(4)]
        out[i] = tuple(sums + 2 * (chains + (not fits and (chain + 1) % 2)) for fits in met)
    return out


def cheapest(initials: list[str], forced: list[bool], extra: list[int]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair, the first in ASCII order among equally cheap ones.

    Depth-first from (row, place) in the order of the edits' letters, under a bound on cost so far plus
    ``bounds``; the bound grows to the least sum it cut off. ``failed`` holds the largest budget that was not
    enough from a state; it stays true under later bounds, so a state is opened again only with more to spend.
    The stack is a list, as a conversation may be longer than Python's.
    """
    n, least = len(initials), bounds(initials, forced, extra)
    failed: dict[tuple[int, int], int] = {}
    bound = least[0][START]
    while True:
        following, spent, audit = None, 0, []
        stack = [(0, START, 0, iter(_edits(0, START, initials, forced, extra)))]
        if not n:
            return 0, ""
        while stack:
            row, place, spent, edits = stack[-1]
            for letter, to_row, to_place, cost in edits:
                total = spent + cost
                need = total + max(least[to_row][to_place], failed.get((to_row, to_place), -1) + 1)
                if need > bound:
                    following = need if following is None else min(following, need)
                    continue
                audit.append(letter)
                if to_row == n and to_place in ENDS:
                    return total, "".join(audit)
                stack.append((to_row, to_place, total, iter(_edits(to_row, to_place, initials, forced, extra))))
                break
            else:
                stack.pop()
                failed[row, place] = max(failed.get((row, place), -1), bound - spent)
                if audit:
                    audit.pop()
        bound = following


def _edits(row: int, place: int, initials: list[str], forced: list[bool], extra: list[int]) -> list[tuple[str, int, int, int]]:
    """(letter, next row, next place, cost) of the edits that a place allows, in ASCII order."""
    to = LEADS[place]
    if row == len(initials):
        return [(INSERT, row, to, COST[INSERT])]
    edits = [(DELETE, row + 1, place, COST[DELETE]), (INSERT, row, to, COST[INSERT])]
    if not forced[row]:
        kept = FOLLOWS[place].get(initials[row])
        if kept is not None:
            edits.append((KEEP, row + 1, kept, COST[KEEP] + extra[row]))
        edits.append((REROLE, row + 1, to, COST[REROLE] + extra[row]))
    return edits


def edited(rows: list[tuple[str, str]], audit: str) -> str:
    """``role:text`` of every row of the repaired conversation, joined by line ends."""
    out, place, i = [], START, 0
    for letter in audit:
        if letter == DELETE:
            i += 1
            continue
        role, text = rows[i] if letter != INSERT else ("", "")
        if letter == KEEP:
            place = FOLLOWS[place][role[:1]]
        else:
            place = LEADS[place]
            role = ROLE_OF[place]
        i += letter != INSERT
        out.append(f"{role}:{text}")
    return "\n".join(out)


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """What COLUMNS names but the id."""
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(initials, [f in (BLANK, DUPLICATE) for f in found], [int(f == TRUNCATED) for f in found])
    return gaps, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), illegal, cost, audit, edited(rows, audit)


def _repair(whole: bool):
    def finish(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done))
        if not whole:
            columns[-1] = [hashlib.sha256(t.encode()).hexdigest() for t in columns[-1]]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, rows, done, held = (), [], [], [], 0
        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies"))):
                if now != (conv_id,):
                    if now:
                        done.append((*now, *repaired(turns, rows)))
                        held += len(done[-1][-1])
                        if held > 1 << 20 or len(done) >= 4096:
                            yield finish(done)
                            done, held = [], 0
                    now, turns, rows = (conv_id,), [], []
                turns += [turn] * copies
                rows += [(role, text)] * copies
        if now:
            done.append((*now, *repaired(turns, rows)))
            yield finish(done)

    return run


def _by_conversation(rows: DataFrame, whole: bool) -> DataFrame:
    columns = COLUMNS if whole else COLUMNS.replace("repaired string", "repaired_sha256 string")
    source = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return source.mapInArrow(_repair(whole), COLUMNS).toDF(*[c.split()[0] for c in columns.split(", ")])


def _rows(conversations: DataFrame) -> DataFrame:
    spoken = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *spoken, F.lit(1).alias("copies"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    the ``repaired`` conversation.

    Rows of ``conversations(conv_id, turn, role, text)`` are taken by turn, null turns first, ties by role and text; other
    columns are not looked at. A null role or text is one space, so the text is blank and the role unfit; rows without
    conv_id are one conversation. No rows give no conversations. Conversations are dealt out by id
    and read in order by a task, which holds one of them at a time; one conversation has to fit into a task, as
    its repaired text fits into a row.
    """
    return _by_conversation(_rows(conversations), True)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the contract's faults laid on; ``copies`` is 0 for a row that is gone, so
    that its conversation is not forgotten, and 2 for one that is repeated."""
    key: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    rows = _rows(conversations).withColumn("kind", kind)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return _by_conversation(damage(table(spark, folder, "conversations")), False)


QUERIES = {"op13_conversation_repair": (query, None)}
