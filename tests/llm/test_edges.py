"""Every operator and pipeline stage on odd rows, on empty tables and beside columns with clashing names."""

import pytest

import corpus_pipeline
from dotforge.llm import decontaminate, fingerprint, language_model, mixing, near_dedup, quality, substring_dedup, toxicity, url_filter, warc

CLASHES = (
    "key tid id class_id class_size own_min kept block word n size source_size target taken position passes ord bucket score predicted "
    "held_out toxic label spans pos positions _size near_key near_tid near_class near_dup _near_tid _near_class _near_root mix_size hot copies lead maybe high low code spot part range guest k h _words _removed _toxic_score c0 c1 row s b rows u v star centre fingerprint payload digest chunk"
).split()
TEXT = " ".join(f"w{i}" for i in range(90))


def tables(spark, empty):
    extra = ", ".join(f"{n} string" for n in CLASHES)
    own, none = ["x"] * len(CLASHES), [None] * len(CLASHES)
    docs = spark.createDataFrame(
        [
            (1, TEXT, "en", "a", 5, *own), (1, TEXT, "en", "a", 5, *own), (2, f"{TEXT} tail", None, None, None, *none), (None, None, None, None, None, *none),
            (None, "", None, "a", 0, *none), (4, " \t\n", "en", "b", 3, *own), (5, "é " * 50_000, "en", "b", 3, *own), (6, "A" * 100_000, "en", "b", 3, *own),
            (7, "one two three", "fr", "c", 9, *own),
        ],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (5, None, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (None, "w1 w2 w3 w4 w5 w6 w7 w8"), (3, None), (4, "")], "item_id long, text string")
    pages = spark.createDataFrame(
        [(1, "http://a.b/c", "<p>" * 50, *own)] * 2 + [(None, None, None, *none), (3, "", "", *own), (4, f"http://{'a.' * 300}/{'p/' * 500}", "z" * 300_000, *own)],
        f"page_id long, url string, html string, {extra}",
    )
    every = {"documents": docs, "labels": labels, "benchmark": bench, "pages": pages}
    return {n: t.limit(0) for n, t in every.items()} if empty else every


@pytest.mark.parametrize("empty", [False, True])
def test_operators(spark, empty):
    t = tables(spark, empty)
    docs, labels, pages = t["documents"], t["labels"], t["pages"]
    one_row_each = [
        near_dedup.near_classes(docs), language_model.score(docs), toxicity.toxicity(docs, labels), quality.quality(docs, labels), mixing.mix(docs),
        mixing.mix(docs, keep=True), substring_dedup.drop_repeats(docs), fingerprint.neighbours(docs),
    ]
    model = toxicity.fit(docs, labels)
    clean = toxicity.toxicity(docs, labels).where("predicted = 0").count()
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).count() == clean
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "_score"] and len(scored.collect()) == (0 if empty else 9)
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.columns == [*docs.columns, "_score"] and len(scored.collect()) == (0 if empty else 9)
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns
    for out in one_row_each:
        assert len(out.collect()) == (0 if empty else 9), out.columns
    for out in (url_filter.judge(pages, labels), warc.round_trip(pages)):
        assert len(out.collect()) == (0 if empty else 5), out.columns
    assert len(decontaminate.contaminated(docs, t["benchmark"]).collect()) == (0 if empty else 4)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty, monkeypatch):
    t = tables(spark, empty)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, d, name: t[name])
    docs = t["documents"]
    clean = toxicity.toxicity(docs, t["labels"]).where("predicted = 0").count()
    left = {"toxicity": clean, "minhash_near_dedup": 6, "substring_dedup": 9, "benchmark_decontamination": 5, "mixing": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or len(out.columns) == len(docs.columns))
        assert len(out.collect()) == (0 if empty else left[name]), name
