import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from kerbside.llm import language_id
from kerbside.llm.language_id import Model, count_phrases, held_out, identify, learn, letters, suffix_automaton


def test_automaton_has_all_substrings_and_no_others():
    text = b"abcbcabbca"
    a = suffix_automaton(text)

    def runs(s):
        state = 0
        for c in s:
            if c not in a[state]:
                return False
            state = a[state][c]
        return True

    assert all(runs(text[i:j]) for i in range(10) for j in range(i, 11))
    assert not runs(b"cc") and not runs(b"ac")


@pytest.mark.parametrize("block", [1, 2, 7, 64, 512])
def test_counts_are_those_of_the_plain_parse_of_whole_texts(monkeypatch, block):
    """However texts are cut: phrases run on over many blocks, and parses meet again late or never."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(block)
    samples = {k: ["".join(rng.choice(v) for _ in range(400))] for k, v in {"x": "abc ", "y": "bcd ", "z": "cdé "}.items()}
    m = Model(samples, 10_000)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 1500))).encode() for _ in range(20)]
    texts += ["".join(samples["x"])[:300].encode() * 4, b"", "".join(samples["y"]).encode(), b"ab" * 700]
    got = m.phrases(texts)
    for k, lang in enumerate(m.languages):
        a = suffix_automaton(samples[lang][0].encode())
        assert got[:, k].tolist() == [count_phrases(a, t) for t in texts]


def test_letters():
    assert letters("A1b²! ÉÉ_x") == "a b éé x" and letters(None) == letters("12 !?") == ""


def test_accuracy_on_held_out_documents(sample):
    d = sample.withColumn("held_out", held_out())
    out = identify(d, learn(d.where("not held_out")), keep=("held_out", "lang")).where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_no_language_is_lost_where_ids_are_null_or_repeated(spark, sample, ids):
    d = sample.withColumn("doc_id", {"null": F.lit(None).cast("long"), "one": F.lit(7), "few": F.col("doc_id") % 3}[ids])
    assert learn(d).languages == learn(sample).languages == sorted(r.lang for r in sample.select("lang").where("lang is not null").distinct().collect())


def test_copies_of_a_text_count_once(spark):
    rows = [("zz", "ein text der sehr oft da ist")] * 500 + [("zz", f"wort{chr(97 + k)} nummer {chr(98 + k)}") for k in range(20)] + [("yy", None), ("yy", "12 34"), (None, "abc")]
    m = learn(spark.createDataFrame(rows, "lang string, text string").withColumn("doc_id", F.lit(1)), sample_rows=96)
    assert m.languages == ["zz"] and m.phrases([b"wortc nummer d"])[0, 0] == 1


def test_edge_cases(docs, empty):
    out = identify(docs, learn(docs)).collect()
    assert len(out) == docs.count()
    assert {r.doc_id for r in out if r.lang_pred == "und"} >= {3, 4, 5, 8}
    assert all(r.lang_pred in ("en", "und") for r in out)
    assert identify(empty, learn(empty)).count() == 0
    assert {r.lang_pred for r in identify(docs, learn(empty)).collect()} == {"und"}


def test_equal_texts_get_equal_languages(docs):
    seen = {}
    d = docs.collect()
    for r, o in zip(sorted(d, key=lambda r: str(r.text)), sorted(identify(docs, learn(docs), keep=("text",)).collect(), key=lambda r: str(r.text)), strict=True):
        assert r.text == o.text and seen.setdefault(o.text, o.lang_pred) == o.lang_pred
