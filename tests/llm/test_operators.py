"""Operators against brute force on small tables, and on the odd tables of conftest."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from odd_tables import EXTRA, PASSAGE, odd_rows
from pyspark.sql import functions as F

from rivertrace.llm import byte_bpe, common, decontamination, language_id, line_dedup, quality, sharding, simhash_dedup, span_dedup, spotsigs, url_filter


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def components_by_hand(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    pairs = set(edges)
    assert got == components_by_hand(sorted(nodes), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_stay_where_they_are(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 4), (4, 3), (100, 90), (100, 90)], "a long, b long")
    near, far = common._near_stars(edges), common._small_star(common._large_star(edges))
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in far.collect()}
    assert near.count() <= edges.count()
    assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()


def test_leads_end_where_they_join_nothing(spark, monkeypatch):
    """Lines that share a segment and are not alike: one round of leads, and the blocks still join the two that are."""
    names = []
    monkeypatch.setattr(common, "write_once", lambda df, name, write=common.write_once: names.append(name) or write(df, name))
    lines = [f"the same beginning of a line {i:03d} " + chr(97 + i % 26) * (3 + i % 40) for i in range(60)]
    docs = spark.createDataFrame([("\n".join(lines + [lines[7] + "!"]),)], "text string")
    roots = {r.node: r.root for r in common.connected_components(line_dedup.near_lines(docs)).collect()}
    assert names.count("lines_pairs") == 1
    assert roots[line_dedup.line_hash(lines[7])] == roots[line_dedup.line_hash(lines[7] + "!")]
    every = [*lines, lines[7] + "!"]
    pairs = [(p, q) for i, p in enumerate(every) for q in every[:i] if line_dedup.alike([p], [q])[0]]
    assert all(roots[line_dedup.line_hash(p)] == roots[line_dedup.line_hash(q)] for p, q in pairs)
    assert set(roots) == {line_dedup.line_hash(x) for pair in pairs for x in pair}


# 1: url filter

URLS = [
    "http://a.example.com/de/1?x=1&y=2", "https://EXAMPLE.net/en/2#t", "https://sub.example.net/de/", "http://net", "http://net/", "ftp://x.org/fr/", "x.org/fr/",
    None, "", "://", "a://b?://c/d", "http://notexample.com/de/", "http://fr.org/frx", "http://ÄB.NET/x\ny/z?q", "http://example.com?/de/", "http://u.example.com/de/#/x",
]


def test_url_rules_and_parts(spark, labels):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.net/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(rows, labels).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), v, r) for v, r in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (max(fits)[2] if fits else None)
        if fits:
            assert got[i].verdict == max(fits)[1]


def test_url_trees_learn_and_ignore_unlabelled(spark):
    urls = [(i, f"http://{'x9' * 9 if i % 3 == 0 else 'site'}{i % 40}.test/{'a/' * (i % 4)}{i}") for i in range(1500)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, marks).collect()}
    assert sum((got[i] == "block") == (i % 3 == 0) for i in range(1, 1500, 2)) >= 740
    assert {r.verdict for r in url_filter.judge(pages, marks.filter("false")).collect()} == {"allow"}
    assert url_filter.judge(pages.filter("false"), marks).count() == 0


# 2: quality


def test_kth_largest(spark):
    rng = random.Random(2)
    keys = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + [5] * 20 + [-1, 0]
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 150, len(keys)):
        assert quality._kth(table, k) == sorted(keys, reverse=True)[k - 1]


def test_quality_keeps_clean_and_drops_junk(spark, small):
    docs, marks = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.sample(docs, marks).select("doc_id").collect()}
    good = [r.doc_id for r in marks.filter("quality = 1 and toxic = 0").collect()]
    junk = [r.doc_id for r in marks.filter("quality = 0").collect()]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in junk) <= 0.1 * len(junk)


def test_quality_drops_documents_with_a_few_toxic_words(spark):
    rng = random.Random(3)
    plain, toxic = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"], ["grim", "vile", "foul", "base"]
    texts, marks = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(300)]
        if bad := i % 6 == 0:
            words[rng.randrange(300)] = rng.choice(toxic)
        texts.append(" ".join(words))
        marks.append((i, 1, int(bad)))
    # The last third has no labels.
    kept = {r.doc_id for r in quality.sample(texts_of(spark, texts), spark.createDataFrame(marks[:800], "doc_id long, quality int, toxic int")).collect()}
    assert not [i for i in kept if i % 6 == 0] and len(kept) >= 0.97 * 1000


def test_quality_on_odd_tables(spark, odd, labels, no_documents):
    got = quality.sample(odd, labels)
    assert set(odd.columns) <= set(got.columns) and got.columns[-2:] == ["log_ratio", "gumbel_key"]
    assert quality.sample(odd, labels.filter("false")).count() == odd.count()
    assert quality.sample(no_documents, labels).count() == 0
    assert quality.stage(spark, odd, "/root/testdata/sf0.001").columns == odd.columns


# 3: decontamination


def windows_by_hand(text, item, threshold=0.8):
    """Best similarity of an item-sized window, all weights equal (one item)."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    a, b = shingles(cut(text)), Counter(shingles(cut(item)))
    m, best = sum(b.values()), 0.0
    for s in range(max(1, len(a) - m + 1)):
        c = Counter(a[s : s + m])
        both = sum((c & b).values())
        best = max(best, both / (sum(c.values()) + m - both) if m else 0)
    return best


def test_decontamination_finds_windows_of_the_threshold(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    words = PASSAGE.split()
    changed = [" ".join("X" if i in gone else w for i, w in enumerate(words)) for gone in ([0], [1], [10], [0, 22], [22], [5, 6], [])]
    texts = [f"{filler(30)} {c} {filler(20)}" for c in changed] + [PASSAGE.upper(), f"{PASSAGE}! {PASSAGE}", filler(300), " ".join(words[:18]), PASSAGE.replace(" ", ", ")]
    item = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in decontamination.contaminated(texts_of(spark, texts), item).collect()}
    for i, t in enumerate(texts):
        best = windows_by_hand(t, PASSAGE)
        if best >= 0.8:
            assert got[i] == pytest.approx(best)
        else:
            assert i not in got


def test_decontamination_equals_containment(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    whole = {(d.doc_id, b.item_id) for b in items.collect() for d in docs.collect() if plain(b.text) in plain(d.text)}
    assert whole <= {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}


def test_decontamination_on_odd_tables(spark, odd, benchmark, no_documents):
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(odd, benchmark).collect()}
    assert got == {(1, 1), (2, 1), (1, 5), (2, 5)}
    kept = decontamination.clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontamination.clean(odd, benchmark.filter("false")).count() == odd.count()
    assert decontamination.contaminated(no_documents, benchmark).count() == 0


def test_every_pair_within_the_radius_shares_a_nibble():
    rng = random.Random(6)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << bit
        assert any(a >> 4 * i & 15 == b >> 4 * i & 15 for i in range(decontamination.NIBBLES))


# 4: sharding


def shard_rows(spark, docs, **options):
    return sharding.shard_documents(docs, **options).collect()


def check_law(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_groups_stay_whole_unless_they_exceed_a_shard(spark):
    rng = random.Random(8)
    texts = [f"g{i % 60}" for i in range(240)] + [f"own {i}" for i in range(300)] + ["hot"] * 260
    rng.shuffle(texts)
    rows = shard_rows(spark, texts_of(spark, texts))
    check_law(rows, 8)
    for g in range(60):
        assert len({r["shard"] for r in rows if texts[r["doc_id"]] == f"g{g}"}) == 1
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_propagation_moves_general_links_together(spark):
    links = [(8 * c + i, 100 + 50 * c + k) for c in range(24) for i in range(8) for k in (i, (i + 1) % 8, (i + 2) % 8)] + [(i, 9) for i in range(0, 192, 97)]
    links = spark.createDataFrame([(r, h) for r, h in links], "row long, hub long")
    rows = spark.range(240).withColumnRenamed("id", "row")
    random_cut = sharding.cut_links(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(8)).cast("int")), links).first()
    cut = sharding.cut_links(sharding.assign(rows, links), links).first()
    assert cut.links == random_cut.links and cut.cut < 0.6 * random_cut.cut


@pytest.mark.parametrize("count", [0, 1, 3, 17])
def test_few_rows(spark, count):
    rows = shard_rows(spark, texts_of(spark, ["same"] * count).limit(count), shards=4)
    assert len(rows) == count
    if count:
        check_law(rows, 4)


def test_sharding_odd_tables(spark, odd):
    rows = shard_rows(spark, odd)
    check_law(rows, 8)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1} and {r["text_crc32"] for r in rows if r["doc_id"] == 3} == {0}


# 5: byte bpe


def test_bpe_query(spark, odd, no_documents):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    whole = byte_bpe.encode_decode(odd, path, pattern).collect()
    digests = byte_bpe.digests(odd, path, pattern).collect()
    assert sorted(bytes(r.decoded) for r in whole) == sorted((t or "").encode() for _, t, *_ in odd_rows())
    assert Counter((r.doc_id, len(r.ids)) for r in whole) == Counter((r.doc_id, r.n_tokens) for r in digests)
    assert Counter(r.decoded_sha256 for r in digests) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_rows())
    assert byte_bpe.digests(no_documents, path, pattern).count() == 0


# 6: language


def test_language_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98
    sample = language_id.training_sample(docs)
    assert all(len(v) <= language_id.DOCS_PER_LANGUAGE and max(map(len, v)) <= language_id.CHARS_PER_DOC for v in sample.values())


def test_language_on_odd_tables(spark, odd, no_documents):
    got = {r.doc_id: r for r in language_id.predict(odd).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {3, 4, 5}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items() if d is not None)
    assert {r.lang_pred for r in language_id.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.predict(no_documents).count() == 0


def test_what_is_broadcast_needs_no_module_of_ours():
    import pickletools

    parts = language_id.Parser({"en": ["the cat sat"], "fr": ["le chat"]}).parts()
    names = [arg for op, arg, _ in pickletools.genops(pickle.dumps(parts)) if isinstance(arg, str)]
    assert not [n for n in names if n.startswith("rivertrace")]
    assert language_id.Parser.of(pickle.loads(pickle.dumps(parts))).judge(["the cat"])[0][0] == "en"


# 7: spotsigs


def test_next_and_edited_texts(spark, odd):
    texts = [f"{'é' * (i % 7)} the text {i} " * (i % 5) for i in range(90)]
    ids = [3 * i * i - 40 for i in range(90)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in spotsigs.with_edit(docs).collect()}
    for k, i in enumerate(ids):
        after = texts[k - 1]  # descending; after the least comes the greatest
        assert got[i].next_text == after
        n = len(texts[k])
        assert got[i].edited == texts[k][: n - n // 3] + after[: n // 3]


def test_spotsigs_likeness(spark):
    base = "The cat of the old town sat on a mat and it was with the dog that is for now in the big house by a river"
    docs = texts_of(spark, [base, base.upper() + "!", base.replace("river", "lake"), "no anchors anywhere here", "", None, "Word", "x | y | z " * 60])
    rows = {r.doc_id: set(r.sigs) for r in spotsigs.with_signatures(docs, "text", "sigs").collect()}
    assert rows[0] == rows[1] and 0.7 < len(rows[0] & rows[2]) / len(rows[0] | rows[2]) < 1
    assert not rows[4] and not rows[5] and rows[3] and rows[6] and rows[7] and not rows[3] & rows[0]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words + spotsigs.ANCHORS[:12] * 3) for _ in range(rng.randrange(2, 90))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(0, 6)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += ["", "", "the", "the"]
    docs = texts_of(spark, texts)
    sigs = {r.doc_id: frozenset(r.sigs) for r in spotsigs.with_signatures(docs, "text", "sigs").collect()}

    def linked(a, b):
        x, y = sigs[a], sigs[b]
        return x == y or (len(x | y) > 0 and len(x & y) / len(x | y) >= 0.8 - 1e-12)

    got = {r.doc_id: r for r in spotsigs.near_copies(docs).collect()}
    assert {d: r.class_id for d, r in got.items()} == components_by_hand(sorted(sigs), linked)
    for d, r in got.items():
        assert r.links == len({sigs[e] for e in sigs if sigs[e] != sigs[d] and linked(d, e)})


def test_spotsigs_on_odd_tables(odd, no_documents):
    rows = spotsigs.with_edit(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    assert spotsigs.with_edit(no_documents).count() == 0 and spotsigs.near_copies(no_documents).count() == 0
    one = spotsigs.with_edit(odd.filter("doc_id = 9")).first()
    assert one.next_text == one.text


# 8: line dedup


def distance_at_most(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1] <= k


def dedup_lines_by_hand(texts, near=None):
    """Alike: one edit for ten characters of the shorter line, at most two."""
    seen = sorted({x.strip(" \t\r") for t in texts for x in t.split("\n") if x.strip(" \t\r")})
    few = lambda a, b: min(2, min(len(a), len(b)) // 10)
    pairs = [(a, b) for i, a in enumerate(seen) for b in seen[i + 1 :] if abs(len(a) - len(b)) <= few(a, b) and few(a, b)]
    near = near or (lambda pairs: [distance_at_most(a, b, few(a, b)) for a, b in pairs])
    linked = {p for p, close in zip(pairs, near(pairs)) if close}
    root = components_by_hand(seen, lambda a, b: (a, b) in linked)
    out, taken = [], set()
    for t in texts:
        kept = []
        for x in t.split("\n"):
            r = root.get(x.strip(" \t\r"))
            if r is None or r not in taken:
                kept.append(x)
            if r is not None:
                taken.add(r)
        out.append("\n".join(kept))
    return out


def line_texts(rng):
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 70))) for _ in range(30)]

    def variant(x):
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x = x[:at] + rng.choice(["", "z"]) + x[at + rng.randrange(2) :]
        return x

    return ["\n".join(variant(rng.choice(base)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 6))) for _ in range(40)]


@pytest.mark.parametrize("rounds, block", [(3, 1000), (0, 1000), (0, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(common, "ROUNDS", rounds)
    monkeypatch.setattr(common, "BLOCK_ROWS", block)
    texts = line_texts(random.Random(10))
    got = {r.doc_id: r for r in line_dedup.dedup(texts_of(spark, texts)).collect()}
    expected = dedup_lines_by_hand(texts)
    assert [got[i].text for i in range(len(texts))] == expected
    assert sum(r.n_dropped for r in got.values()) == sum(a.count("\n") + 1 - (b.count("\n") + 1 if b else 0) for a, b in zip(texts, expected))


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    lines = [word(rng.randrange(1, 29)) for _ in range(60)]
    lines += [x[:-1] + "é" for x in lines[::2]] + [x[1:] + "z" for x in lines[::3]]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    seen = sorted({x for t in texts for x in t.split("\n") if x})
    root = components_by_hand(seen, lambda a, b: distance_at_most(a, b, min(2, min(len(a), len(b)) // 10)))
    expected, taken = [], set()
    for t in texts:
        kept = []
        for x in t.split("\n"):
            if not x or root[x] not in taken:
                kept.append(x)
                taken.add(root.get(x))
        expected.append("\n".join(kept))
    got = {r.doc_id: r.text for r in line_dedup.dedup(texts_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_short_different_lines_stay(spark):
    lines = "yes no Yes cat dog 12.5 12.9 2019 2021 sum end Mon Tue red 99 bed".split()
    assert [r.text for r in line_dedup.dedup(texts_of(spark, ["\n".join(lines)])).collect()] == ["\n".join(lines)]


def test_template_lines_give_few_pairs(spark, monkeypatch):
    """All lines of a template are alike: what is compared grows with their number, not with its square."""
    pairs = []
    monkeypatch.setattr(common, "write_once", lambda df, name, write=common.write_once: pairs.append((name, (out := write(df, name)).count())) or out)
    lines = [f"Order {i:03d} of the day has been shipped and will arrive within a week" for i in range(400)]
    got = line_dedup.dedup(texts_of(spark, lines)).collect()
    assert sum(r.text == "" for r in got) == 399 and sum(n for name, n in pairs if name == "lines_pairs") <= 10 * 400


def test_lines_of_odd_tables(spark, odd, no_documents):
    got = line_dedup.dedup(odd.drop("repeats_of"))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[3].text is None and rows[4].text == "" and rows[2].text == "" and rows[2].repeats_of == [1]
    assert rows[1].n_dropped == 0 and rows[10].n_lines == 400 and rows["x" == 0 or 8].n_dropped == 0
    assert got.count() == odd.count() and line_dedup.dedup(no_documents).count() == 0
    kept = line_dedup.stage(spark, odd, "")
    assert kept.columns == odd.columns and {r.tk for r in kept.select("tk").collect()} == {"tk"}


# 9: simhash


def test_components_equal_brute_force(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    values = set(base)
    for b in base:
        for _ in range(14):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                b ^= 1 << bit
            values.add(b)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    got = {(r.a, r.b) for r in simhash_dedup.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}


def test_choices_of_positions_are_not_broadcast(spark, tmp_path):
    """A saved table of fingerprints is small enough for Spark to broadcast; its choices, 28 rows for each, may not be."""
    spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long").write.parquet(f"{tmp_path}/nodes")
    links = simhash_dedup.linked_fingerprints(spark.read.parquet(f"{tmp_path}/nodes"))
    assert {(r.a, r.b) for r in links.collect()} == {(1, 3), (1, 1 << 40)}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_simhash_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in simhash_dedup.components(docs).collect()}
    prints = {r.doc_id: simhash_dedup.fingerprint(r.text) for r in docs.collect()}
    expected = components_by_hand(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {d: r.component_id for d, r in got.items()} == expected
    assert all(r.fp % (1 << 64) == prints[d] for d, r in got.items())
    assert {r.doc_id for r in simhash_dedup.keep_one(docs).collect()} == {d for d, c in expected.items() if d == c}


@pytest.mark.parametrize("rounds", [3, 0])
def test_stage_drops_all_texts_of_jaccard_similarity(spark, odd, monkeypatch, rounds):
    monkeypatch.setattr(common, "ROUNDS", rounds)
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 140))] + passage * rng.randrange(2)
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed[: len(changed) - rng.randrange(2)]))

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, prints = [shingles(t) for t in texts], [simhash_dedup.fingerprint(t) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    docs = texts_of(spark, texts)
    roots = components_by_hand(range(len(texts)), lambda a, b: alike(a, b) or near(a, b))
    assert {r.doc_id for r in simhash_dedup.stage(spark, docs, "").collect()} == {d for d, c in roots.items() if c == d}
    assert roots != components_by_hand(range(len(texts)), near)
    assert Counter(r.doc_id for r in simhash_dedup.stage(spark, odd, "").collect()) == Counter({1: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: 1})


def test_texts_travel_only_for_pairs_that_may_be_alike(spark, monkeypatch):
    rng = random.Random(14)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(40) for _ in range(6)]  # each in fewer texts than make its shingles frequent
    texts = [some(100) + " " + passages[i % 6] for i in range(30)]
    texts += [texts[0] + " end", texts[1] + " end"]
    sent, write = Counter(), simhash_dedup.write_once

    def counted(df, name):
        saved = write(df, name)
        sent[name] += saved.count()
        return saved

    monkeypatch.setattr(simhash_dedup, "write_once", counted)
    assert {r.doc_id for r in simhash_dedup.stage(spark, texts_of(spark, texts), "").collect()} == set(range(30))
    assert sent["texts"] <= 4


def test_rows_and_not_ids_are_kept(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta", "quite another text with other words in it")
    ids = "doc_id long, text string"
    kept = lambda rows: sorted(map(str, map(tuple, simhash_dedup.keep_one(spark.createDataFrame(rows, ids)).collect())))
    assert kept([(1, one), (5, one), (5, two)]) == sorted(map(str, [(1, one), (5, two)]))
    assert kept([(1, one), (1, two), (1, two)]) == sorted(map(str, [(1, one), (1, two)]))
    assert kept([(None, one), (None, one), (3, two), (None, two)]) == sorted(map(str, [(None, one), (3, two)]))


def test_simhash_on_odd_tables(odd, no_documents):
    rows = simhash_dedup.components(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows()) and by[2].component_id == 1 and {by[d].component_id for d in (3, 4, 5)} == {3} and by[3].fp == 0
    kept = simhash_dedup.keep_one(odd)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns and Counter(ids) == Counter({1: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: 1})
    assert simhash_dedup.components(no_documents).count() == 0 and simhash_dedup.keep_one(no_documents).count() == 0


# 10: spans


def test_spans_equal_brute_force(spark):
    rng = random.Random(14)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) + rng.choice([". ", "!\n", "? ", "\n"])
    shared = ["".join(sentence() for _ in range(5)) for _ in range(4)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.3 else sentence() for _ in range(rng.randrange(0, 9))) for _ in range(40)]
    got = {r.doc_id: r for r in span_dedup.dedup(texts_of(spark, texts)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        parts, gone, sources = span_dedup.sentences(t), set(), set()
        for at, n, h in span_dedup.runs(parts):
            if h in seen:
                gone |= set(range(at, at + n))
                sources.add(seen[h])
            else:
                seen[h] = i
        assert got[i].text == "".join(t[s:e] for k, (s, e, _) in enumerate(parts) if k not in gone)
        assert got[i].n_removed == len(gone) and set(got[i].repeats_of) == sources


def test_every_repeated_run_of_sentences_goes(spark):
    """Spans enumerated here: every run of two sentences and twelve words or more."""
    rng = random.Random(15)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + ". "
    passages = ["".join(sentence(n) for n in lengths) for lengths in ((15, 14, 3, 3), (12, 2), (3, 3, 15), (5, 1, 1, 9, 1), (3, 3, 3, 3))]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.5 else sentence(rng.randrange(1, 15)) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    got = {r.doc_id: r for r in span_dedup.dedup(texts_of(spark, texts)).collect()}
    parts, seen, gone = [re.findall(r"[^.]*\. ", t) for t in texts], set(), [set() for _ in texts]
    for d, p in enumerate(parts):
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if len(" ".join(p[i:j]).split()) >= 12:
                    key = " ".join(p[i:j])
                    if key in seen:
                        gone[d] |= set(range(i, j))
                    seen.add(key)
    assert [got[d].text for d in range(len(texts))] == ["".join(x for i, x in enumerate(p) if i not in gone[d]) for d, p in enumerate(parts)]


def test_spans_of_odd_tables(odd, no_documents):
    got = span_dedup.dedup(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert set(EXTRA) <= set(got.columns) and got.count() == odd.count()
    assert rows[3].text is None and rows[4].text == "" and rows[1].n_removed == 0 and rows[2].repeats_of == [1] and PASSAGE not in rows[2].text
    assert len(rows[7].text) < 2000 and span_dedup.dedup(no_documents).count() == 0


# registered queries


def test_queries_cover_their_tables(spark, small):
    from rivertrace.llm.catalog import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    documents = duckdb.sql(f"SELECT count(*) FROM '{small}/documents.parquet'").fetchall()[0][0]
    pages = duckdb.sql(f"SELECT count(*) FROM '{small}/pages.parquet'").fetchall()[0][0]
    conversations = duckdb.sql(f"SELECT count(DISTINCT conv_id) FROM '{small}/conversations.parquet'").fetchall()[0][0]
    expected = {"op1_": pages, "op11": conversations + 1, "op13": conversations}
    for name, (query, _) in QUERIES.items():
        rows = query(spark, small).count()
        if name.startswith(("op2_", "op3_", "op12")):
            assert 0 < rows
        else:
            assert rows == expected.get(name[:4], documents), name


def test_entropy_feature(spark):
    row = spark.createDataFrame([("aabbccdd",), ("",)], "url string").select(url_filter.entropy(F.col("url")).alias("e")).collect()
    assert [round(r.e, 9) for r in row] == [2.0, 0.0] and math.isfinite(row[1].e)


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 40 * 100)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    narrow = spark.range(100)
    wide = narrow.select("id", F.struct("id", F.struct(F.col("id").alias("n")).alias("about")).alias("lead"))
    assert "broadcast" in plan(common.sized_broadcast(narrow)).lower()
    assert "broadcast" not in plan(common.sized_broadcast(wide)).lower()
    assert "broadcast" not in plan(common.sized_broadcast(spark.range(101))).lower()


def test_frequent_shingles_are_taken_by_whole_counts(spark, monkeypatch):
    texts = ["a b c d e"] * 3 + ["v w x y z"] * 2 + ["k l m n o"]
    rows = spark.createDataFrame([(i, t + f" {i}") for i, t in enumerate(texts)], "node long, text string")
    monkeypatch.setattr(simhash_dedup, "ORDER_COPIES", 2)
    hashes = {t: int(simhash_dedup.shingle_set(t)[0]) for t in ("a b c d e", "v w x y z")}
    known, ranks = simhash_dedup._common(rows)
    assert [int(known[list(ranks).index(k)]) for k in (0, 1)] == [hashes["v w x y z"], hashes["a b c d e"]]
    monkeypatch.setattr(simhash_dedup, "ORDER_ROWS", 1)
    known, ranks = simhash_dedup._common(rows)
    assert known.tolist() == [hashes["a b c d e"]] and ranks.tolist() == [0]
    monkeypatch.setattr(simhash_dedup, "ORDER_COPIES", 9)
    assert len(simhash_dedup._common(rows)[0]) == 0
