"""The pipeline's stages on their own inputs, against plain versions."""

from __future__ import annotations

from granary.llm.queries import tokenizer_path
from tests.llm import plain
from tests.llm.test_operators import check_packing, line_plain


def test_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else {}
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in after.values())
            steps[name] = before, after
    before, after = steps["quality_rules"]
    assert all(not plain.quality(r.text)[5] for r in after.values()) and len(after) > 0.8 * sum(not plain.quality(r.text)[5] for r in before.values())
    before, after = steps["line_dedup"]
    gone = line_plain([(d, r.text) for d, r in before.items()])
    for d, r in before.items():
        left = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[d])
        assert (after[d].text == left) if d in after else not plain.SPACED.search(left)
    before, after = steps["near_dedup"]
    assert set(after) == {d for d, (_, c) in plain.near_components([(d, r.text) for d, r in before.items()]).items() if c == d}
    before, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for d, r in before.items():
        n, hit, _ = plain.contamination(r.text, items)
        if not hit:
            assert after[d].text == r.text
        elif d in after:
            assert not plain.contamination(after[d].text, items)[1] and len(hit) <= n / 2
        else:
            assert len(hit) > n / 2
    assert check_packing(docs.collect(), 1024) > 0
    assert {r.doc_id for r in docs.collect()} == set(after) and tokenizer_path()


def test_stages_on_odd_and_empty_tables(spark, sf):
    import corpus_pipeline

    from tests.llm.test_operators import ODD, words

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, None, None, None) for d, t in ODD] + [(50, " ".join(words(90, 5)), "en", "s", 1), (51, " ".join(words(90, 5)), "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, spark.createDataFrame(data, schema), sf).collect()  # each stage also on what the first one would have dropped
            assert bool(alone) == bool(data) or name == "quality_rules"
            out = stage(spark, docs, sf)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r.doc_id for r in docs.collect()} == ({5, 50} if data else set())


def test_run_leaves_the_last_stage_only(spark, sf):
    from pathlib import Path

    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100
    folder = Path(out.inputFiles()[0].removeprefix("file:")).parents[1]
    assert [p.name for p in folder.iterdir()] == ["packing"]


def test_near_dedup_from_four_fifths(spark, sf):
    import corpus_pipeline

    from tests.llm.test_operators import words

    near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"]
    base = words(94, 8)
    # 90 shingles; a changed word at either end costs one, in the middle five: 82 of 98 shared (0.837), 75 of 105 (0.714)
    close = [base[0] + "x", *base[1:50], "new", *base[51:-2], "last", base[-1]]
    apart = [*base[:20], "x", *base[21:40], "y", *base[41:60], "z", *base[61:]]
    data = [(d, " ".join(t), None, None, None) for d, t in ((1, base), (2, close), (3, apart))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [plain.shingle_set(r[1]) for r in data]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8
    assert {r.doc_id for r in near_dedup(spark, docs, sf).collect()} == {1, 3}
