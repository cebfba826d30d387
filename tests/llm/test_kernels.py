"""Python helpers against plain versions of the same computation."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash

from rivertrace.llm import byte_bpe, language_id, line_dedup, simhash_dedup, span_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng):
    signs = [" ", "  ", "\n", "\t", "'s", "'re", "the", "ing", "é", "ß", "ñ", "日本", "🙂", " ", " ", "12", "!?", "<|endoftext|>", "\x1c", "\x85"]
    return "".join(rng.choice(signs) if rng.random() < 0.6 else chr(rng.randrange(32, 0x250)) for _ in range(rng.randrange(80)))


def test_codec_encodes_like_the_library_and_decodes_back(codec, library):
    rng = random.Random(3)
    texts = ["", " ", "a" * 5000, "é" * 700, "\n" * 300] + [random_text(rng) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_finds_every_token(codec):
    words = [t for t in codec.tokens if t]
    numbers = codec.hash.lookup(byte_bpe._hashes(words))
    assert sorted(numbers.tolist()) == list(range(len(words)))
    assert [codec.tokens[codec.slots[n]] for n in numbers] == words


def test_codec_of_no_texts(codec):
    assert codec.encode([]) == [] and codec.encode(["", ""])[1].tolist() == []


def simhash(text, words=3):
    tokens = [t for t in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "A", "a b", "A b C", "x y\tz\vw", "É É É a b c", "the " * 300, "İ I i ΑΒ"])
def test_simhash(text):
    assert simhash_dedup.fingerprint(text) == simhash(text)


def test_sketches_never_differ_in_more_places_than_sets_in_hashes():
    rng = np.random.default_rng(15)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for n, m, shared in [(0, 0, 0), (1, 1, 0), (1, 1, 1), (60, 70, 55), (64, 65, 64), (500, 520, 480), (1000, 1300, 1000), (3000, 4000, 0), (4096, 4097, 4000)]:
        rows = rng.permutation(pool)[: n + m - shared]
        a, b = np.sort(rows[:n]), np.sort(rows[n - shared :])
        found = simhash_dedup.differing(simhash_dedup.sketch(a), simhash_dedup.sketch(b))
        assert found == simhash_dedup.differing(simhash_dedup.sketch(b), simhash_dedup.sketch(a)) <= n + m - 2 * shared
        assert found > (n + m) / 9 or shared or n < 2
        assert simhash_dedup.differing(simhash_dedup.sketch(a), simhash_dedup.sketch(a)) == 0
        assert max(8, n / 8) <= len(simhash_dedup.sketch(a)) <= max(8, n / 4)


def test_simhash_of_random_texts():
    rng = random.Random(5)
    for _ in range(50):
        text = " ".join(rng.choice(["Aa", "b", "Cé", "dd\n", "e"]) for _ in range(rng.randrange(60)))
        assert simhash_dedup.fingerprint(text) == simhash(text)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def mutated(text, rng):
    letters = list(text)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "ñ"])
    return "".join(letters)


def test_banded_distance_and_keys_lose_no_pair():
    rng = random.Random(7)
    left = ["".join(rng.choice("abñ") for _ in range(rng.randrange(60))) for _ in range(1500)]
    right = [mutated(x, rng) for x in left]
    near = [edit_distance(a, b) <= 2 for a, b in zip(left, right)]
    assert line_dedup.within(left, right).tolist() == near
    assert line_dedup.within([], []).tolist() == []
    for a, b, close in zip(left, right, near):
        if close:
            assert ((line_dedup.letter_parity(a) ^ line_dedup.letter_parity(b)) & ((1 << 64) - 1)).bit_count() <= 4
    few = [line_dedup.allowed(min(len(a), len(b))) for a, b in zip(left, right)]
    alike = [edit_distance(a, b) <= k for a, b, k in zip(left, right, few)]
    assert line_dedup.alike(left, right).tolist() == alike and sum(alike) > 300
    keys, owners = line_dedup.line_keys(left + right)
    found = [set() for _ in range(3000)]
    for key, i in zip(keys.tolist(), owners.tolist()):
        found[i].add(key)
    assert all(a == b or found[i] & found[i + 1500] for i, (a, b, close) in enumerate(zip(left, right, alike)) if close)
    assert len(line_dedup.line_keys([])[0]) == 0 and len(line_dedup.line_keys(["", "short"])[0]) == 0


def test_automaton_holds_all_substrings_and_no_more():
    rng = random.Random(11)
    codes = [rng.randrange(3, 6) for _ in range(60)]
    to = language_id.suffix_automaton(codes)
    there = {tuple(codes[i:j]) for i in range(60) for j in range(i, min(60, i + 6) + 1)}
    for _ in range(500):
        word = [rng.randrange(3, 6) for _ in range(rng.randrange(1, 6))]
        state = 0
        for c in word:
            state = to[state].get(c)
            if state is None:
                break
        assert (state is not None) == (tuple(word) in there)


def test_phrases_equal_a_plain_parse():
    rng = random.Random(13)
    sample = {"aa": ["".join(rng.choice("abc ") for _ in range(80))], "bb": ["".join(rng.choice("bcd ") for _ in range(80))]}
    parser = language_id.Parser(sample)
    texts = ["".join(rng.choice("abcdeé 1") for _ in range(rng.randrange(1, 700))) for _ in range(40)]
    phrases, lengths = parser.phrases(texts)
    for i, language in enumerate(parser.languages):
        learned = parser.alphabet.encode(sample[language][0]).tolist() + [language_id.GAP]
        grams = {tuple(learned[a:b]) for a in range(len(learned)) for b in range(a + 1, len(learned) + 1)}
        for k, text in enumerate(texts):
            codes, expected = parser.alphabet.encode(text).tolist(), 0
            assert len(codes) == lengths[k]
            for at in range(0, max(1, len(codes)), language_id.SEGMENT):
                phrase, expected = (), expected + 1
                for c in codes[at : at + language_id.SEGMENT]:
                    if phrase + (c,) in grams:
                        phrase += (c,)
                        continue
                    expected += bool(phrase)
                    phrase = (c,) if (c,) in grams else ()
                    expected += not phrase
            assert phrases[i, k] == expected


def test_sentences_tile_the_text_and_copies_are_cut_alike():
    rng = random.Random(17)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    for _ in range(30):
        head = " ".join("".join(rng.choice("xyz") for _ in range(4)) for _ in range(rng.randrange(0, 40)))
        text = f"{head} {passage} {head}. ??\n{head}"
        parts = span_dedup.sentences(text)
        assert "".join(text[s:e] for s, e, _ in parts) == text
        assert all(len(w) <= span_dedup.LONGEST for _, _, w in parts)
        hashes = {h for _, _, h in span_dedup.runs(parts)}
        assert hashes & {h for _, _, h in span_dedup.runs(span_dedup.sentences(passage))}
    assert span_dedup.sentences("") == [] and span_dedup.sentences("... \n") == []


def test_repeated_words_do_not_overflow():
    assert simhash_dedup.fingerprint("a " * 200_000) == simhash_dedup.fingerprint("a " * 5)
    assert np.bincount([len(p[2]) for p in span_dedup.sentences("for " * 2000)]).sum() > 100


def test_small_blocks_join_what_large_ones_do():
    rng = np.random.default_rng(4)
    blocks, node = [], 0
    for size in rng.integers(2, line_dedup.SMALL_BLOCK + 1, 60):
        base = ["".join(rng.choice(list("abcd"), 24)) for _ in range(4)]
        rows = []
        for _ in range(size):
            line = list(base[rng.integers(4)])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(len(line))] = "x"
            line = "".join(line)
            rows.append((node, int(rng.integers(5)) if node % 3 else node, len(line), line_dedup.letter_parity(line), bool(rng.integers(2)), line))
            node += 1
        blocks.append(rows)

    def classes(links, rows):
        up = {r[0]: ("root", r[1]) for r in rows}

        def top(x):
            while x in up and up[x] != x:
                x = up[x]
            return x

        for x, y in links:
            p, q = top(x), top(y)
            if p != q:
                up[p] = q
        groups = {}
        for r in rows:
            groups.setdefault(top(r[0]), set()).add(r[0])
        return sorted(map(sorted, groups.values()))

    links = line_dedup._small_links(blocks)
    for rows in blocks:
        ids, root, n, parity, side, lines = zip(*rows)
        plain = line_dedup._block_links(np.array(root), np.array(n), np.array(parity).view(np.uint64), np.array(side), lines)
        mine = [(x, y) for x, y in links if x in ids]
        assert classes(mine, rows) == classes([(ids[i], ids[j]) for i, j in plain], rows)


def test_line_keys_are_dealt_and_met(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 60))).strip() + "x" for _ in range(400)]
    lines = [x for x in lines if len(x) >= 10]
    texts = ["\n".join(lines[:300]), None, "\n".join([*lines[100:], *(x[:7] + "y" + x[7:] for x in lines[:80])])]
    texts.append("\n".join("a template of lines, number " + str(i) for i in range(200)))  # keys of many lines at once
    every = sorted({x for t in texts if t for x in t.split("\n")})
    keys, owners = line_dedup.line_keys(every)
    met = {}
    for key, owner in zip(keys.tolist(), owners.tolist()):
        met.setdefault(key, set()).add(line_dedup.line_hash(every[owner]))
    expected = {(k, v) for k, found in met.items() if len(found) > 1 for v in found}
    for step in (1, 1 << 20):
        monkeypatch.setattr(line_dedup, "STEP_KEYS", step)
        dealt = [r for t in texts for b in line_dedup._keyed(iter([pa.record_batch({"text": pa.array([t], pa.string())})])) for r in b.to_pylist()]
        assert sum(len(r["keys"]) for r in dealt if not r["known"]) < 8 * len(keys) * 2
        home = {r["part"] for r in dealt}
        assert home <= set(range(line_dedup.PARTS))
        rows = pa.Table.from_pylist(sorted(dealt, key=lambda r: r["part"]), pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("nodes", pa.binary())]))
        got = [tuple(r.values()) for b in line_dedup._shared(iter(rows.to_batches(max_chunksize=50))) for r in b.to_pylist()]
        assert set(got) == expected and expected
    # A key that one line has alone goes no further; one of many lines takes two of them to its part.
    assert any(r["known"] for r in dealt)
