"""Language by cross-parsing: the labelled language whose text explains a document in the fewest phrases."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivertrace.llm.common import pieces, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCS_PER_LANGUAGE = 64
CHARS_PER_DOC = 500
SEGMENT = 256
FOLDS, HELD_OUT = 4, 2
SHARPNESS = 8
UNDETERMINED = "und"
LETTERS = 120
PAD, GAP, RARE = 0, 1, 2
HAS_LETTER = regex.compile(r"\p{L}")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_DOC) -> dict[str, list[str]]:
    """At most ``per_language`` spans of ``chars`` code points for each language, whole texts where they are shorter: a
    bounded sample of the labelled rows outside the held-out fold, the same for every order of rows. Rows are
    drawn and spans placed by a hash of the id, so no part of a text is preferred. The top-k is cut per task
    before the shuffle, so a language with most of the rows sends no more than a small one."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    rows = docs.filter((fold() != HELD_OUT) & F.col("lang").isNotNull() & (F.trim("text") != "")).select(
        "lang", F.substring(F.col("text"), place.cast("int"), F.lit(chars)).alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id"
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    sample: dict[str, list[str]] = {}
    for row in rows.withColumn("place", place).filter(F.col("place") <= per_language).orderBy("lang", "place").collect():
        sample.setdefault(row.lang, []).append(row.text)
    return sample


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class Alphabet:
    """Lower-case letters of the training text by number; other letters share one, all else is a gap."""

    def __init__(self, texts: list[str]) -> None:
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.size = len(letters) + 3
        self.codes = np.full(0x110000, GAP, np.uint8)
        every = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.codes[every] = RARE
        for i, c in enumerate(letters):
            self.codes[ord(c)] = i + 3

    def encode(self, text: str) -> np.ndarray:
        """Numbers of the whole text; a run of gaps is one gap."""
        raw = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        gap = raw == GAP
        return raw[~(gap & np.concatenate([[False], gap[:-1]]))] if len(raw) else raw


class Parser:
    """Automata of all languages as one table. An entry holds the next row of the table and how many
    phrases end there: where no match goes on, a phrase ends and the next begins with this letter; a letter
    the language never has is a phrase of its own."""

    def __init__(self, sample: dict[str, list[str]]) -> None:
        self.languages = sorted(sample)
        self.alphabet = Alphabet([t for ts in sample.values() for t in ts])
        width, parts, self.roots, self.weights, base = self.alphabet.size, [], [], [], 0
        for language in self.languages:
            codes: list[int] = []
            for t in sample[language]:
                codes += self.alphabet.encode(t).tolist() + [GAP]
            to = suffix_automaton(codes)
            root = np.zeros(width, np.int64)
            ends = np.full(width, 2, np.int64)
            for c, s in to[0].items():
                root[c], ends[c] = s, 1
            rows = np.broadcast_to(((base + root) * width << 2) | ends, (len(to), width)).copy()
            rows[0] = ((base + root) * width << 2) | (ends - 1)
            at = np.array([(s, c, n) for s, step in enumerate(to) for c, n in step.items()], np.int64).reshape(-1, 3)
            rows[at[:, 0], at[:, 1]] = (base + at[:, 2]) * width << 2
            rows[:, PAD] = (base + np.arange(len(to))) * width << 2
            parts.append(rows)
            self.roots.append(base * width)
            self.weights.append(math.log2(len(codes) + 2))
            base += len(to)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        if len(self.table) and self.table.max() < 1 << 31:
            self.table = self.table.astype(np.int32)

    def parts(self) -> tuple:
        """Lists and arrays alone, which a task can read that does not have this module."""
        return self.languages, self.alphabet.size, self.alphabet.codes, self.roots, self.weights, self.table

    @classmethod
    def of(cls, parts: tuple) -> Parser:
        parser, alphabet = cls.__new__(cls), Alphabet.__new__(Alphabet)
        parser.languages, alphabet.size, alphabet.codes, parser.roots, parser.weights, parser.table = parts
        parser.alphabet = alphabet
        return parser

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text under every language, and lengths. Phrases also end every ``SEGMENT``
        letters, for all languages alike, so that all segments can be parsed side by side."""
        codes = [self.alphabet.encode(t) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        segments = np.maximum(1, -(-lengths // SEGMENT))
        cells = np.full((int(segments.sum()), SEGMENT), PAD, np.uint8)
        flat, at = cells.ravel(), 0
        for c, s in zip(codes, segments.tolist()):
            flat[at : at + len(c)] = c
            at += s * SEGMENT
        columns = np.ascontiguousarray(cells.T)
        counts = np.ones((len(self.languages), len(cells)), np.int32)
        for i, root in enumerate(self.roots):
            state, count = np.full(len(cells), root, self.table.dtype), counts[i]
            for column in columns:
                state += column
                step = self.table.take(state)
                count += (step & 3).astype(np.int32)
                state = step >> 2
        return np.add.reduceat(counts, np.cumsum(segments) - segments, axis=1), lengths

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. Ties go to the language first in order."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and self.languages and HAS_LETTER.search(t)]
        if not asked:
            return out
        phrases, lengths = self.phrases([texts[i] for i in asked])
        entropy = phrases * np.array(self.weights)[:, None] / np.maximum(lengths, 1)
        best = entropy.argmin(axis=0)
        likeness = (entropy.min(axis=0) / entropy) ** SHARPNESS
        scores = 1 / likeness.sum(axis=0)
        for i, b, s in zip(asked, best.tolist(), scores.tolist()):
            out[i] = (self.languages[b], s)
        return out


def _predictor(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Parser.of(parts.value).judge
        for batch in pieces(batches):
            judged = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x[0] for x in judged], pa.string()),
                    pa.array([x[1] for x in judged], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, sample: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, judged by its whole text only.

    The automata are built from a bounded sample (``training_sample``), so what is broadcast depends on
    the number of languages and not on the documents. ``score`` is the winner's share of inverse
    entropies, 1 where only one language is known. A text that is null or has no letter, and every text when
    nothing was learned, is ``und`` with score 0. A row without doc_id is judged and not held out.
    """
    parts = docs.sparkSession.sparkContext.broadcast(Parser(training_sample(docs) if sample is None else sample).parts())
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text"
    )
    return source.mapInArrow(_predictor(parts), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return predict(table(spark, folder, "documents"))


QUERIES = {"op6_language_id": (query, None)}
