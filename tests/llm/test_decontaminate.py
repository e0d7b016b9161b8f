import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kerbside.llm import decontaminate
from kerbside.llm.decontaminate import Matcher, Pattern, budget, contaminated, normal, pieces


def substring_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=20), st.text(alphabet="abc", max_size=40))
def test_distance(p, t):
    assert Pattern(p).distance(t) == substring_distance(p, t)


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for k in range(min(n, 9)):
            got = pieces("x" * n, k)
            assert len(got) == k + 1 and sum(len(p) for _, p in got) == n and [a for a, _ in got] == [sum(len(q) for _, q in got[:i]) for i in range(k + 1)]


def test_finds_every_edited_copy():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(12)]
    m = Matcher(items, 0.08)
    for i, t in items:
        k = budget(len(t), 0.08)
        for edits in (0, 1, k):
            s = list(t)
            for _ in range(edits):
                p = rng.randrange(len(s))
                s[p] = rng.choice(["z", "", s[p] + "q"])
            text = " ".join(rng.choice(words) for _ in range(50)) + " " + "".join(s) + " " + " ".join(rng.choice(words) for _ in range(50))
            want = sorted((j, d) for j, u in items if (d := substring_distance(u, text)) <= budget(len(u), 0.08))
            assert m.find(text) == want and any(j == i for j, _ in want)


def test_operator(spark, docs, empty):
    bench = spark.createDataFrame([(7, "The QUICK brown\nfox jumps over the lazy dog"), (8, None), (9, "tiny"), (None, "the quick brown fox jumps over the lazy dog"), (7, "quick brown fox jumps over the lazy cat"), (5, " \n"), (3, "One")], "item_id long, text string")
    out = contaminated(docs, bench, keep=("n_chars",)).collect()
    assert len(out) == docs.count() and "n_chars" in out[0].asDict()
    assert {r.doc_id for r in out if r.leaked} == {0, 1, 2, 6, 7}
    assert {r.doc_id: r.item_ids for r in out}[0] == [None, 7] and {r.doc_id: r.item_ids for r in out}[6] == [3]
    assert all(len(r.item_ids) == len(r.distances) == r.n_items for r in out)
    assert contaminated(empty, bench).count() == 0
    assert not any(r.leaked for r in contaminated(docs, bench.limit(0)).collect())


def test_short_items_are_whole_words():
    m = Matcher([(1, "a b"), (2, "word"), (3, "42")], 0.08)
    assert m.find("a b") == [(1, 0)] and m.find("xa b") == [] and m.find("a bc a b.") == [(1, 0)]
    assert m.find("swords word's") == [(2, 0)] and m.find("words") == [] and m.find("142 421 (42)") == [(3, 0)]


def test_blocks_of_items_change_no_result(spark, sample, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda: sorted((r.doc_id, r.item_ids, r.distances) for r in contaminated(sample, bench).collect())
    one = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(decontaminate, "BROADCAST_FINDS", 0)
    assert rows() == one and any(r[1] for r in one)


def test_edited_items_of_the_sample_against_brute_force(spark, sample):
    """Every item within its budget is found, and no other, in all texts short enough for loops."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    items = [(r.item_id, normal(r.text)) for r in bench.collect()]
    edited = [(1000 + k, "so it says: " + t[: len(t) // 3] + t[len(t) // 3 + 1 + k % 3 :] + " and no more") for k, (_, t) in enumerate(items)]
    texts = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").where("length(text) < 1500").collect()] + edited
    got = {r.doc_id: list(zip(r.item_ids, r.distances)) for r in contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    for i, t in texts:
        assert got[i] == sorted((j, d) for j, u in items if (d := Pattern(u).distance(normal(t))) <= budget(len(u), 0.08))
    assert all(got[i] for i, _ in edited)


def test_sample_against_plain_search(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {r.doc_id: set(r.item_ids) for r in contaminated(sample, bench).collect()}
    items = [(r.item_id, normal(r.text)) for r in bench.collect()]
    for r in sample.select("doc_id", "text").collect():
        t = normal(r.text)
        assert {i for i, u in items if u in t} <= got[r.doc_id]
