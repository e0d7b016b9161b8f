import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm.importance import bucket_counts, buckets, gains_of, ranked, resample, suffixes, words


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return w, [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, size=10_000, percent=5, least=20):
    counts = [Counter(zlib.crc32(f) % size for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target)]
    s, t = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1.0) * (t * 0 + s + size) / ((counts[0][b] + 1.0) * (t + size)))) for b in range(size)]
    rows = {}
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x) % size] for x in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least]
    enough = sorted((i for i in rows if rows[i][4]), key=lambda i: (-rows[i][2], i))
    for k, i in enumerate(enough[: percent * len(enough) // 100]):
        rows[i][3] = k + 1
    return {(i, *r[:4]) for i, r in rows.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é-\x00", max_size=30), max_size=5))
def test_buckets_at_every_place(texts):
    ids, known, first = words(texts)
    place = buckets(ids, known, first, 997)
    for t, (a, b) in zip(texts, zip(first[:-1], first[1:], strict=True), strict=True):
        w, f = features(t)
        assert [known[i] for i in ids[a:b]] == w
        got = [int(x) for p in place for x in p[a:b] if x >= 0]
        assert got == [zlib.crc32(x) % 997 for x in f]


def test_suffixes_of_many_words_are_sorted_alike():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 9, 500)
    first = np.array([0, 3, 3, 250, 500])
    order, common = suffixes(ids, first)
    far, same = suffixes(ids + (1 << 40) * (ids > 4), first)
    assert sorted(order.tolist()) == list(range(500)) and np.array_equal(common, same) and np.array_equal(order, far)
    ends = np.repeat(first[1:], np.diff(first))
    keys = [tuple(ids[i : min(i + 3, ends[i])]) for i in order]
    assert keys == sorted(keys)


def test_the_whole_sample_against_plain_counting(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {tuple(r) for r in resample(sample, bench).drop("n_words").collect()}
    assert got == plain([(r.doc_id, r.text) for r in sample.collect()], [r.text for r in bench.collect()])


def test_edge_cases(spark, docs):
    """Nulls in all columns, blanks, repeated rows and clashing names: every row comes back."""
    out = resample(docs.withColumnRenamed("bands", "rank"), docs.select("text"), keep=("rank",), min_words=1, percent=100).collect()
    assert len(out) == docs.count()
    drawn = [r for r in out if r.n_words > 0]
    assert sorted(r[-1] for r in drawn) == list(range(1, len(drawn) + 1)) and all(r[-1] is None for r in out if not r.n_words)
    assert all(r.n_features == r.weight == 0 for r in out if not r.n_words)
    by_rank = sorted(drawn, key=lambda r: r[-1])
    assert [r.score for r in by_rank] == sorted((r.score for r in drawn), reverse=True)


def test_empty_tables(empty, docs):
    assert resample(empty, docs).collect() == [] and bucket_counts(empty).collect() == []
    assert resample(docs, empty).count() == docs.count()
    assert set(gains_of(empty, empty).tolist()) == {0}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(f"d{k}", "one two three " * k) for k in range(12)], "doc_id string, text string")
    out = resample(df, df, percent=50, min_words=3).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5]


def test_ties_go_to_the_smaller_id(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, k % 2) for k in range(40)], "i long, s long").repartition(7)
    out = {r.i: r["rank"] for r in ranked(df, [F.desc("s"), F.asc("i")], 75).collect()}
    assert [out[k] for k in (1, 3, 39, 0, 18)] == [1, 2, 20, 21, 30] and out[20] is None


def test_texts_like_the_target_are_drawn(spark):
    rows = [(k, ("green fields of barley " if k % 10 == 0 else "loud engines on wet roads ") * 10) for k in range(400)]
    target = spark.createDataFrame([("barley grows on green fields of barley",)] * 20, "text string")
    out = resample(spark.createDataFrame(rows, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(out) == 20 and all(r.doc_id % 10 == 0 for r in out)
