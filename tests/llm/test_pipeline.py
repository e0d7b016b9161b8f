from test_minhash_dedup import brute

import corpus_pipeline
from kerbside.llm.decontaminate import normal
from kerbside.llm.pii import hide


def test_stages_one_after_the_other(spark):
    """Each stage against a plain version of it, on what the one before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {r.doc_id: r for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf).cache()
        assert out.columns == list(corpus_pipeline.COLUMNS)
        now = {r.doc_id: r for r in out.collect()}
        assert len(now) == out.count() and set(now) <= set(kept)
        if name == names[0]:
            assert set(now) == {i for i, r in kept.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == names[1]:
            assert set(now) == {i for i, _, first, _ in brute([(i, r.text) for i, r in kept.items()]) if i == first}
        elif name == names[2]:
            items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {i for i, r in kept.items() if any(t in normal(r.text) for t in items)}
            assert leaks.isdisjoint(now) and len(set(kept) - set(now)) <= len(leaks) + 2
        else:
            assert set(now) == set(kept) and all(now[i].text == hide(kept[i].text) and now[i].n_chars == len(now[i].text) for i in now)
        kept = now
    last = corpus_pipeline.STAGES[-1][1](spark, out, sf).collect()
    assert {r.doc_id for r in last} == set(kept)
    run = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(run) == key(last)


def test_rows_with_nulls_and_repeats(spark):
    rows = [(1, "A plain text of more than five words here.", None, None, None), (1, "A plain text of more than five words here.", "en", "s", 3), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, "some words without any id", "en", None, None), (4, "Write to a@b.cc about the garden and the trees", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    out = {r.doc_id: r.text for r in docs.collect()}
    assert set(out) == {1, 4, None} and out[4].startswith("Write to [EMAIL]") and docs.count() == 3


def test_dedup_keeps_unlike_texts_of_one_id(spark):
    a, b, c = "the first text has more than five words in it", "quite another text that is like no other one here", "a third text which nothing else in this table is like"
    rows = [(2, a), (2, b), (1, a), (2, b), (None, b), (None, c), (None, c), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, c), (1, a), (2, b), (5, "")]


def test_documents_stay_where_no_language_was_learned(spark):
    rows = [(1, "A plain text without a label.", None, "s", 29), (2, "éß", None, None, None), (3, "12 34 !", None, "s", 7), (4, None, "en", "s", None), (5, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.text, r.lang) for r in out} == {(1, rows[0][1], "und"), (2, "éß", "und")}
