"""Spelling variants: a trie of letter-group counts, searched with a surplus and a deficit of one, leaves verified."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import pieces, sized_broadcast, table
from rivertrace.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = re.compile("[a-zÀ-ÿ]+")
DELETE_ONE_IN = 31
CHARS, OCCURRENCES, FACTOR = 7, 2, 10
HELD_WORDS = 200_000
#: Letters fall into GROUPS by code point modulo GROUPS, and these into COARSE by the same rule. The first step down
#: the trie, the counts of the coarse groups, is taken by Spark: words meet in a task under them. The order of the other
#: levels has groups of frequent letters first.
GROUPS, COARSE = 24, 4
LEVELS = (5, 14, 1, 20, 9, 15, 18, 8, 3, 21, 19, 12, 4, 2, 6, 7, 17, 16, 13, 23, 0, 22, 11, 10)
LEAF_WORDS = 16
PIECE_WORDS = 20_000
_LETTERS = [chr(0x100 + g) for g in LEVELS]
_FINE = {c: chr(0x100 + c % GROUPS) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))}


def damaged(doc_id: int | None, run: str) -> str:
    """The run as the contract has it: without one code point where 31 divides its hash."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETE_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str | None) -> list[str]:
    """Maximal runs of letters; only A-Z are lower-cased, which ``bytes.lower`` does."""
    return RUN.findall((text or "").encode().lower().decode())


def _counted(damage: bool, chars: int):
    def table_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(runs_of(text)).items():
                    if len(word) < chars:
                        continue
                    if damage:
                        word = damaged(doc_id, word)
                        if len(word) < chars:
                            continue
                    counts[word] += n
            if len(counts) > HELD_WORDS:
                yield table_of(counts)
                counts.clear()
        yield table_of(counts)

    return run


def vocabulary(docs: DataFrame, damage: bool = False, chars: int = CHARS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): words of ``chars`` code points or more that occur ``occurrences`` times or more. Tasks add up their
    words before the shuffle, so a frequent word is a few rows per task."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = source.mapInArrow(_counted(damage, chars), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _shape(word: str) -> str:
    return word.translate(_FINE)


def _coarse(shape: str) -> tuple[int, ...]:
    counts = [0] * COARSE
    for g, n in Counter(shape).items():
        counts[ord(g) % COARSE] += n
    return tuple(counts)


#: The steps from a word's coarse counts to those it looks under: the group with one letter more there and the one with
#: one letter less. Of two opposite steps one is here: each pair of words is looked for from one side.
ANY, NONE = COARSE, -1
STEPS = ((ANY, ANY), *((up, down) for up in range(COARSE) for down in (*range(up + 1, COARSE), NONE)))
KEPT, AT_HOME = -1, 0


def _onward(counts: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(number, counts) of each step that leads anywhere; the first is to stay."""
    yield AT_HOME, counts
    for k, (up, down) in enumerate(STEPS[1:], 1):
        step = list(counts)
        step[up] += 1
        if down != NONE:
            step[down] -= 1
            if step[down] < 0:
                continue
        yield k, tuple(step)


def _dealt(looking: bool):
    """(bucket, kind, word, n): each word where it is kept, and where it looks for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word"):
            bucket, rows, kind = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                counts = _coarse(_shape(word))
                found = [(KEPT, counts), *(_onward(counts) if looking else ())]
                bucket += [",".join(map(str, c)) for _, c in found]
                rows += [k] * len(found)
                kind += [step for step, _ in found]
            at = pa.array(rows, pa.int32())
            columns = [pa.array(bucket, pa.string()), pa.array(kind, pa.int32()), batch.column("word").take(at), batch.column("n").take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "word", "n"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    half = len(a) // 2
    if len(b) - len(a) > 1 or a == b or (a[:half] != b[:half] and a[half:] != b[len(b) - len(a) + half :]):
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


class Trie:
    """Words of one bucket, so of one length, by the counts of their letter groups, a level for each group. A branch of
    few words is a leaf before its last level; words with the same counts everywhere share a leaf however many they
    are. A leaf lists its words by each half of theirs, since one edit leaves one of the halves as it was."""

    def __init__(self, words: list[str]) -> None:
        self.length = len(words[0])
        self.root = self._node([(_shape(w), w) for w in words], 0)

    def _node(self, words: list[tuple[str, str]], level: int):
        if len(words) <= LEAF_WORDS or level == GROUPS:
            halves: dict[str, list[str]] = {}
            for _, w in words:
                for key in self._halves(w):
                    halves.setdefault(key, []).append(w)
            return (halves,)
        letter, branches = _LETTERS[level], {}
        for pair in words:
            branches.setdefault(pair[0].count(letter), []).append(pair)
        return {n: self._node(branch, level + 1) for n, branch in branches.items()}

    def _halves(self, word: str) -> tuple[str, str]:
        """What a word has in place of the first half of the words here and, after an edit in that, of their rest. The
        mark keeps both apart."""
        half = self.length // 2
        return word[:half], word[max(0, half + len(word) - self.length) :] + "\n"

    def near(self, word: str, step: int = AT_HOME) -> Iterator[str]:
        """Every word of the trie one edit from ``word``, once. The search has a surplus and a deficit of one to spend;
        ``step``, which led from the word to this bucket, says in which coarse groups, or, where both are at home, that
        one coarse group takes both."""
        count, (first, rest) = _shape(word).count, self._halves(word)
        stack = [(self.root, 0, *STEPS[step])]
        while stack:
            node, level, up, down = stack.pop()
            if type(node) is dict:
                n, coarse, level = count(_LETTERS[level]), LEVELS[level] % COARSE, level + 1
                if (same := node.get(n)) is not None:
                    stack.append((same, level, up, down))
                if (up == coarse or up == ANY) and (more := node.get(n + 1)) is not None:
                    stack.append((more, level, NONE, coarse if down == ANY else down))
                if (down == coarse or down == ANY) and (less := node.get(n - 1)) is not None:
                    stack.append((less, level, coarse if up == ANY else up, NONE))
                continue
            halves = node[0]
            one, two = halves.get(first), halves.get(rest)
            for other in {*one, *two} if one and two else one or two or ():
                if one_edit(word, other):
                    yield other


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best): of the near words found in a piece of a bucket, how many each word has and the
    most frequent one. Of two words of one bucket, the one later in order looks for the other."""
    names = ["word", "n_near", "best_n", "best"]

    def table_of(found: dict[str, tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        rest = [pa.array([v[i] for v in found.values()], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *rest], names)

    def note(found: dict, word: str, n: int, other: str) -> None:
        count, best_n, best = found.get(word, (0, 0, ""))
        if n > best_n or (n == best_n and other < best):
            best_n, best = n, other
        found[word] = count + 1, best_n, best

    now, kept, trie, found = None, {}, None, {}
    for batch in batches:
        for bucket, piece, kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "piece", "kind", "word", "n"))):
            if now != (bucket, piece):
                if found:
                    yield table_of(found)
                now, kept, trie, found = (bucket, piece), {}, None, {}
            if kind == KEPT:
                kept[word] = n
                continue
            if not kept:
                continue
            if trie is None:
                trie = Trie(list(kept))
            for other in trie.near(word, kind):
                if kind == AT_HOME and other > word:
                    continue
                note(found, word, kept[other], other)
                note(found, other, n, word)
            if len(found) > HELD_WORDS:
                yield table_of(found)
                found = {}
    if found:
        yield table_of(found)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``words(word, n)`` that have near ones: how many, and the most
    frequent of them, ties to the first in code-point order.

    A pair of near words has counts of the coarse groups that differ by a surplus of one, a deficit of one or
    both. Each word is kept under its own counts and looks under those it may reach, 11 at most. A bucket
    of more than ``PIECE_WORDS`` words is kept in pieces, each with a trie of its own, and those that look there
    look into all; they pass a piece as a stream. Pairs never leave the task that finds them.
    """
    dealt = words.mapInArrow(_dealt(True), "bucket string, kind int, word string, n long")
    sizes = words.mapInArrow(_dealt(False), "bucket string, kind int, word string, n long").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    sizes = write_once(sizes.select("bucket", F.ceil(F.col("size") / PIECE_WORDS).cast("int").alias("pieces")), "buckets")
    own: Column = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    piece = F.explode(F.when(F.col("kind") == KEPT, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1)))
    placed = dealt.join(sized_broadcast(sizes), "bucket").select("bucket", piece.alias("piece"), "kind", "word", "n")
    placed = placed.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "kind")
    found = placed.mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: where following forms ends. Every round doubles the steps taken; a
    form is ten times as frequent as its word, so there are few."""
    now = write_once(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = write_once(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words(word, n)``, each word once.

    ``form`` is the near word of largest n (ties: first in code-point order) if it occurs ``factor`` times as often
    or more, else null; ``root`` is where forms lead to in the end, the word itself if it has none.
    """
    words = write_once(words, "words")
    forms = F.col("best_n") >= F.col("n") * factor
    rows = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(forms, F.col("best")).alias("form"), F.when(forms, F.col("best_n")).alias("form_n")
    )
    rows = write_once(rows, "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, damage: bool = False) -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs(doc_id, text)``.

    Null and empty texts have no words; repeated rows count each. Other columns are not looked at. No rows give no
    words. ``damage`` deletes a code point of one run in 31, by a hash of the run and its doc_id (a null id is
    an empty one), as a source of misspellings.
    """
    return variants(vocabulary(docs, damage))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return group_variants(table(spark, folder, "documents"), damage=True)


QUERIES = {"op12_spelling_variants": (query, None)}
