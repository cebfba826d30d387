"""The pipeline's stages take effect on one another's output, checked with plain Python on the smallest tables."""

from collections import Counter

from test_operators import components_by_hand, dedup_lines_by_hand

from rivertrace.llm import decontamination, line_dedup, simhash_dedup


def test_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
        assert max(Counter(r.doc_id for r in seen[name]).values()) == 1
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash_dedup", "decontamination", "byte_bpe"]

    rows = {r.doc_id: r for r in before}
    assert all(rows[r.doc_id] == r for r in seen["quality"]) and len(seen["quality"]) < len(before)

    ordered = sorted(seen["quality"], key=lambda r: r.doc_id)
    # The distance itself is held against the plain recurrence in test_kernels; there are too many lines for it here.
    close = lambda pairs: line_dedup.alike([a for a, _ in pairs], [b for _, b in pairs])
    expected = dict(zip([r.doc_id for r in ordered], dedup_lines_by_hand([r.text for r in ordered], close), strict=True))
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == expected
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])

    prints = {d: simhash_dedup.fingerprint(t) for d, t in expected.items()}
    words = {d: t.lower().split() for d, t in expected.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    roots = components_by_hand(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or alike(a, b))
    assert {r.doc_id for r in seen["simhash_dedup"]} == {d for d, c in roots.items() if c == d}

    items = spark.read.parquet(f"{small}/benchmark.parquet")
    leaked = {r.doc_id for r in decontamination.contaminated(spark.createDataFrame(seen["simhash_dedup"]), items).collect()}
    assert {r.doc_id for r in seen["decontamination"]} == {r.doc_id for r in seen["simhash_dedup"]} - leaked

    texts = {r.doc_id: r.text for r in seen["decontamination"]}
    assert {r.doc_id: r.text for r in seen["byte_bpe"]} == texts
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == Counter(list(texts))
