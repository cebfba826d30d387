"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrace.llm.common import pieces, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: white space as the tokenizer's pattern understands it (the Unicode property White_Space).
WHITE_SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
MEMO_ENTRIES = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(i) for _, i in pairs) + 1)
    for word, i in pairs:
        tokens[int(i)] = base64.b64decode(word)
    return tokens


class PerfectHash:
    """Minimal perfect hash by levels of bit sets: a key takes the first level where no other remaining
    key meets it, and its number is the rank of that bit. Keys outside the set get some number or -1."""

    def __init__(self, hashes: np.ndarray, spread: float = 1.5) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = hashes, 0
        while len(left):
            size = max(64, int(len(left) * spread))
            at = self._place(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            ranks = base + np.cumsum(bits) - bits
            self.levels.append((bits, ranks))
            base += int(bits.sum())
            left = left[~bits[at]]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(hashes[open_], level, len(bits))
            hit = bits[at]
            found[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return found


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Codec:
    """Encodes and decodes with one vocabulary; plain arrays, so it is the same on every executor."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        known = [i for i, t in enumerate(tokens) if t]
        words = [tokens[i] for i in known]
        self.hash = PerfectHash(_hashes(words))
        self.slots = np.zeros(len(known), np.int64)
        self.slots[self.hash.lookup(_hashes(words))] = known
        self.ranks = {w: i for w, i in zip(words, known)}
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pattern = regex.compile(pattern.replace(r"\s\p", WHITE_SPACE + r"\p").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))
        self.memo: dict[bytes, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word outside the vocabulary: the pair of lowest rank, leftmost first, is merged until
        none is left. Pairs wait in a heap, neighbours are linked; n bytes take n log n steps."""
        ranks, n = self.ranks, len(word)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if not ends[i] or j >= n or ends[j] != end or ends[i] != j:
                continue  # one of the two has changed since
            ends[i], ends[j] = end, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(word[i : ends[k]])
                if rank is not None:
                    heappush(heap, (rank, i, ends[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get(word[h:end])
                if rank is not None:
                    heappush(heap, (rank, h, end))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : ends[i]]])
            i = after[i]
        return ids

    def words(self, uniques: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: how many each has, and all of them in a row."""
        raw = [u.encode() for u in uniques]
        slot = self.hash.lookup(_hashes(raw))
        at = np.where(slot >= 0, self.slots[slot], -1).tolist()
        tokens, memo = self.tokens, self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        found = []
        for word, i in zip(raw, at):
            if i >= 0 and tokens[i] == word:
                found.append((i,))
                continue
            ids = memo.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) < 64:
                    memo[word] = ids
            found.append(ids)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return counts, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [self.pattern.findall(t) for t in texts]
        flat = np.array([w for p in parts for w in p], dtype=object)
        codes, uniques = pd.factorize(flat)
        counts, ids = self.words(list(uniques))
        first = np.cumsum(counts) - counts
        per = counts[codes] if len(codes) else np.zeros(0, np.int64)
        out = np.cumsum(per) - per
        everything = ids[np.repeat(first[codes] - out, per) + np.arange(int(per.sum()))] if len(codes) else ids
        cuts = np.cumsum([len(p) for p in parts])
        ends = np.concatenate([[0], np.cumsum(per)])[cuts] if len(parts) else []
        return np.split(everything, ends[:-1]) if len(parts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        per = self.lengths[ids]
        out = np.cumsum(per) - per
        return self.bytes[np.repeat(self.starts[ids] - out, per) + np.arange(int(per.sum()))].tobytes()


def _coder(tokens: list[bytes], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokens, pattern)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode(texts)
            decoded = [codec.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([i.view(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return run


def _digester(tokens: list[bytes], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokens, pattern)
        for batch in pieces(batches):
            ids = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids of the whole text without special tokens and the bytes they
    stand for. A null text is empty: no ids, no bytes. The vocabulary is read on the driver and travels
    with the task (a fixed file of less than a megabyte)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_coder(read_ranks(ranks_path), pattern), "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``encode_decode`` with the ids and bytes as digests, taken where they are made: ids are four
    bytes each, more than the text itself, and need not leave the worker."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(
        _digester(read_ranks(ranks_path), pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(docs, path, public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


QUERIES = {"op5_byte_bpe": (query, None)}
