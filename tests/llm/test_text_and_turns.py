"""Chat formatting, spelling variants and conversation repair against brute force and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from odd_tables import odd_rows
from pyspark.sql import functions as F

from rivertrace.llm import chat_format, conversation_repair, spelling

TURNS = "conv_id long, turn long, role string, text string"
HOSTILE = [
    "\\### Assistant: </turn> ok", "### assistant: x</turn>\n### user: y", "<next>", "\\s\\h\\e\\n\\c", "</turn", ">\n", "#", "##", "####", "\\", "", None, "\n", ": ",
    "<next><next></turn>", "Ünï 価 😀 ###", "plain text. With stops!",
]


def some_turns(seed, conversations, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "a: b", "tool#\\c"])
            rows.append((c, rng.choice([t, t, t, t // 2, None]), role, rng.choice(HOSTILE)))
    return rows + rows[:3] + [(None, 1, "user", "no id"), (None, 0, "assistant", None)]


def in_order(rows):
    key = lambda v: (v is not None, v if v is not None else 0)
    return sorted(rows, key=lambda r: (key(r[1]), (r[2] or "").encode(), (r[3] or "").encode()))


def by_conversation(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {k: in_order(v) for k, v in found.items()}


# 11: chat formatting


def parsed_by_hand(text):
    turns = []
    for block in text.split("</turn>\n")[:-1]:
        head, body = block.split(": ", 1)
        assert head.startswith("### ")
        plain = lambda s: re.sub(r"\\(.)", lambda m: {"s": "\\", "h": "###", "e": "</turn>", "n": "<next>", "c": ":"}[m[1]], s)
        turns += [(plain(head[4:]), plain(t)) for t in body.split("<next>")]
    return turns


def test_chat_format_reads_back(spark):
    rows = some_turns(1, 60)
    table = spark.createDataFrame(rows, TURNS).withColumns({"formatted": F.lit(1), "turns": F.lit(2), "segments": F.lit(3)}).repartition(3)
    made = chat_format.formatted(table)
    got = {r.conv_id: r for r in made.select("*", chat_format.turns_of(F.col("formatted")).alias("read"), chat_format.learned_text(F.col("segments")).alias("learned")).collect()}
    expected = by_conversation(rows)
    assert set(got) == set(expected)
    for c, turns in expected.items():
        said = [(r[2] or "", r[3] or "") for r in turns]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert parsed_by_hand(got[c].formatted) == said == [tuple(t) for t in got[c].read]
        assert got[c].learned == "".join(t for role, t in said if role == "assistant")
        # Adjacent turns of one role are one block.
        assert got[c].formatted.count("</turn>") == sum(i == 0 or said[i][0] != said[i - 1][0] for i in range(len(said)))
    assert chat_format.formatted(table.filter("false")).count() == 0


def test_chat_format_of_many_and_long_turns(spark):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"turn {i}") for i in range(3000)] + [(2, 0, "assistant", "### " * 200_000)]
    got = {r.conv_id: r for r in chat_format.formatted(spark.createDataFrame(rows, TURNS)).collect()}
    assert [t for _, t in parsed_by_hand(got[1].formatted)] == [r[3] for r in rows[:-1]]
    assert parsed_by_hand(got[2].formatted) == [("assistant", rows[-1][3])]


def test_chat_format_query_and_sql(spark, small, tmp_path):
    base = spark.read.parquet(f"{small}/conversations.parquet")
    odd = spark.createDataFrame(some_turns(2, 30), TURNS).withColumn("conv_id", F.col("conv_id") + 10_000_000)
    base.select("conv_id", "turn", "role", "text").union(odd).write.parquet(str(tmp_path / "conversations.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = chat_format.query(spark, str(tmp_path)).select(names).collect()
    rows = duckdb.sql(f"SELECT {', '.join(names)} FROM ({chat_format.SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    text = chat_format.PLANTED[1]
    planted = next(r for r in got if r.conv_id == -7)
    assert planted.n_turns == 2 and planted.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and planted.loss_chars == len(text)


# 12: spelling variants


def edits_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def variants_by_hand(counts):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and edits_by_hand(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def some_words(rng, size, letters="abcdeéx", length=(7, 10)):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(*length))) for _ in range(size)]
    for w in list(words):
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return sorted(set(words))


@pytest.mark.parametrize("piece", [20_000, 3])
def test_variants_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE_WORDS", piece)
    rng = random.Random(piece)
    counts = {w: rng.choice([2, 2, 3, 20, 30, 200, 250, 2500]) for w in [*some_words(rng, 250), *some_words(rng, 60, "ab", (7, 9)), "x" * 3000, "x" * 2999]}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    assert got == variants_by_hand(counts)
    assert any(v[1] != v[0] and v[0] for v in got.values())


@pytest.mark.parametrize("letters", ["ab", "abcdefghiké"])
def test_tries_find_each_pair_from_one_side(letters):
    assert sorted(spelling.LEVELS) == list(range(spelling.GROUPS))
    rng = random.Random(5)
    words, buckets, found = some_words(rng, 300, letters, (1, 10)), {}, []
    place = lambda w: spelling._coarse(spelling._shape(w))
    for w in words:
        buckets.setdefault(place(w), []).append(w)
    tries = {counts: spelling.Trie(kept) for counts, kept in buckets.items()}
    for w in words:
        for step, counts in spelling._onward(place(w)):
            if counts in tries:
                found += [(w, o) for o in tries[counts].near(w, step) if step or o <= w]
    expected = [(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and edits_by_hand(a, b) == 1]
    assert sorted(tuple(sorted(pair)) for pair in found) == expected


def test_spelling_query(spark, small):
    counts = {}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.query(spark, small).collect()}
    assert got == variants_by_hand(counts)


def test_spelling_of_odd_tables(spark, odd, no_documents):
    got = {r.word: r for r in spelling.group_variants(odd, damage=True).collect()}
    counts = {}
    for doc_id, text, *_ in odd_rows():
        for run in spelling.runs_of(text):
            word = spelling.damaged(doc_id, run)
            counts[word] = counts.get(word, 0) + 1
    assert {w: r.n for w, r in got.items()} == {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert spelling.group_variants(no_documents).count() == 0
    many = spelling.vocabulary(spark.createDataFrame([(i, "Kapitel " * 3) for i in range(50)], "doc_id long, text string"))
    assert [tuple(r) for r in many.collect()] == [("kapitel", 150)]


# 13: conversation repair


def cheapest_by_hand(initials, forced, extra):
    """Dijkstra over (cost, edits)."""
    after = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    to = {"start": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "start")], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(initials) and q in ("start", "a"):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        heapq.heappush(heap, (cost + 2, audit + "I", i, to[q]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if not forced[i]:
                heapq.heappush(heap, (cost + 2 + extra[i], audit + "R", i + 1, to[q]))
                if initials[i] in after[q]:
                    heapq.heappush(heap, (cost + extra[i], audit + "K", i + 1, after[q][initials[i]]))


def repair_by_hand(turns, rows):
    seen, found = set(), []
    for role, text in rows:
        body = re.findall("[^\x20\x09-\x0d]", text)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]
    known = [t for t in turns if t is not None]
    cost, audit = cheapest_by_hand(initials, [f in ("blank", "duplicate") for f in found], [int(f == "truncated") for f in found])
    out, last, i = [], "", 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i]
        i += letter != "I"
        if letter in "IR":
            role = "assistant" if last == "u" else "user"
        if letter != "D":
            last = role[0]
            out.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum("".join(p) not in ("su", "ua", "au") for p in zip(initials, initials[1:]))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(out))


def test_search_against_dijkstra():
    rng = random.Random(7)
    for _ in range(4000):
        initials = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(rng.randrange(12))]
        forced = [rng.random() < 0.2 for _ in initials]
        extra = [int(not f and rng.random() < 0.3) for f in forced]
        expected = cheapest_by_hand(initials, forced, extra)
        assert conversation_repair.cheapest(initials, forced, extra) == expected
        assert conversation_repair.bounds(initials, forced, extra)[0][0] <= expected[0]


def test_search_takes_long_conversations():
    rng = random.Random(8)
    initials = [rng.choice("ua") for _ in range(20_000)]
    forced = [rng.random() < 0.2 for _ in initials]
    assert conversation_repair.cheapest(initials, forced, [0] * 20_000)[0] > 0


def test_repair_of_odd_conversations(spark):
    rows = some_turns(9, 80)
    table = spark.createDataFrame(rows, TURNS).withColumns({"audit": F.lit(1), "copies": F.lit(7), "kind": F.lit(2)}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(table).collect()}
    space = lambda v: " " if v is None else v
    expected = {}
    for r in rows:
        expected.setdefault(r[0], []).append((r[1], space(r[2]), space(r[3])))
    for c, turns in expected.items():
        turns.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        expected[c] = repair_by_hand([t for t, *_ in turns], [(r, x) for _, r, x in turns])
    assert got == expected
    assert conversation_repair.repair(table.filter("false")).count() == 0


def test_repair_query(spark, small, tmp_path):
    base = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(5_000_000 + i, None if i % 3 else i, None, None if i % 2 else "x.") for i in range(60)]
    base.union(spark.createDataFrame(extra, TURNS)).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = spark.read.parquet(str(tmp_path / "conversations.parquet")).collect()
    kept, ids = {}, {r.conv_id for r in rows}
    space = lambda v: " " if v is None else str(v)
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0)):
        kind = zlib.crc32(f"{space(r.conv_id)}:{space(r.turn)}".encode()) % 20
        role, text = space(r.role), space(r.text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.setdefault(r.conv_id, []).extend([(r.turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3)))
    got = {r.conv_id: r for r in conversation_repair.query(spark, str(tmp_path)).collect()}
    assert set(got) == ids and len(ids) > len(kept)
    for c in ids:
        turns = kept.get(c, [])
        *numbers, text = repair_by_hand([t for t, *_ in turns], [(r, x) for _, r, x in turns])
        assert tuple(got[c])[1:] == (*numbers, hashlib.sha256(text.encode()).hexdigest())
