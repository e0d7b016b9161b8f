import hashlib
import re
from collections import Counter

from kerbside.llm.fingerprints import compare_with_edits, fingerprint, lexicon, with_likeness, with_next


def edited(rows):
    """rows (id, text) -> the edited text of each."""
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        out[i] = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
    return out


def test_sample(sample):
    out = {r.doc_id: r for r in compare_with_edits(sample, lexicon(sample)).collect()}
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    want = edited(rows)
    assert len(out) == len(rows)
    by_text = {}
    for i, t in rows:
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert by_text.setdefault(t, out[i].fingerprint) == out[i].fingerprint
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    n = len(rows)
    assert sum(r.near_edited for r in out.values()) / n > 0.2 > 0.1 > sum(r.near_next for r in out.values()) / n


def test_stretches_give_the_same_neighbours(sample):
    one = {r.id: r.next for r in with_next(sample, "doc_id", "text").where("not last").collect()}
    many = {r.id: r.next for r in with_next(sample, "doc_id", "text", rows_each=7).where("not last").collect()}
    assert one == many and len(one) == sample.count()


def plain_order(rows, hashes):
    """Rows (id, text) by falling id, null ids last, then by hash and text."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""], r[1] or ""))


def test_ids_that_many_rows_share_are_cut_by_hash(spark):
    rows = [(None, f"text {k}") for k in range(60)] + [(7, f"seven {k % 40}") for k in range(80)] + [(k, f"own {k}") for k in range(30)] + [(-(1 << 63) + 1, "low"), (2**60, "high"), (2**60 + 1, "higher"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = plain_order(rows, hashes)
    want = sorted((i is None, i or 0, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order))
    for each in (2000, 7, 3):
        out = with_next(df, "doc_id", "text", rows_each=each)
        assert sorted((r.id is None, r.id or 0, r.text, r.next) for r in out.where("not last").collect()) == want
    assert max(r["count"] for r in out.groupBy("stretch").count().collect()) <= 25


def parts(fingerprint):
    return [fingerprint[k : k + 4] for k in range(0, 320, 4)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if "=" in (a[0], b[0]):
        return 0.0
    total = equal = 0
    for level in range(5):
        pairs = list(zip(parts(a), parts(b)))[level * 16 : level * 16 + 16]
        held = [(x, y) for x, y in pairs if (x, y) != ("----", "----")]
        if len(held) < 16:
            total, equal = total + len(held), equal + sum(x == y for x, y in held)
    if not total:
        total, equal = 16, sum(x == y for x, y in list(zip(parts(a), parts(b)))[64:])
    return equal / total


def test_lexicon_codes_and_likeness_against_plain_versions(spark, sample):
    known = lexicon(sample, least=0.01, most=0.3)
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    held = {i: {w for w in re.split(r"[^\w]+|_", t.lower()) if w} for i, t in texts.items()}
    df = Counter(w for ws in held.values() for w in ws)
    band = {w for w, n in df.items() if n >= 2 and 0.01 * len(texts) <= n <= 0.3 * len(texts)}
    names = {r.term: r.w for r in spark.createDataFrame([(w,) for w in df], "w string").selectExpr("w", "xxhash64(w) as term").collect()}
    rows = known.collect()
    assert {names[r.term] for r in rows} == band and {names[r.term] for r in rows if r.level == 0} == band
    subset = {}
    for r in rows:
        subset.setdefault(names[r.term], set()).add(r.level * 16 + r.slot)
    out = {r.doc_id: r for r in compare_with_edits(sample, known).collect()}
    seen = [{} for _ in range(80)]
    for i, r in out.items():
        mine = [frozenset(w for w in held[i] & band if k in subset[w]) for k in range(80)]
        if not any(mine):
            assert r.fingerprint.startswith("=")
            continue
        for k, (terms, code) in enumerate(zip(mine, parts(r.fingerprint))):
            assert (code == "----") == (not terms) and seen[k].setdefault(terms, code) == code
    for codes in seen:  # different sets have different codes, but for chance at 16 bits
        assert len(set(codes.values())) >= len(codes) - 2
    order = sorted(out, reverse=True)
    for k, i in enumerate(order):
        after = out[order[(k + 1) % len(order)]]
        assert abs(out[i].near_edited - plain_likeness(out[i].fingerprint, out[i].edited_fingerprint)) < 1e-9
        assert abs(out[i].near_next - plain_likeness(out[i].fingerprint, after.fingerprint)) < 1e-9


def test_likeness_of_texts_that_fill_all_levels(spark):
    a = "".join(f"{k:04x}" for k in range(80))
    b = "".join(f"{k + 1000 * (k % 4 == 0):04x}" for k in range(80))
    rows = with_likeness(spark.createDataFrame([(a, b)], "a string, b string"), {"near": ("a", "b")}).first()
    assert rows.near == plain_likeness(a, b) == 0.75


def test_edge_cases(docs, empty, sample):
    out = compare_with_edits(docs, lexicon(docs)).collect()
    assert len(out) == docs.count()
    assert all(len(r.edited_sha256) == 64 and r.fingerprint for r in out)
    assert {r.n_chars for r in out if r.doc_id == 4} == {0}
    known = lexicon(empty)
    assert known.count() == 0 and compare_with_edits(empty, known).collect() == []
    # no lexicon: equal texts are alike, others are not
    assert all(r.fingerprint.startswith("=") for r in compare_with_edits(docs, known).collect())


def test_one_document(spark):
    df = spark.createDataFrame([(5, "abcdefghi")], "doc_id long, text string")
    (r,) = compare_with_edits(df, lexicon(df)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and r.near_next == 1.0


def test_fingerprint_of_equal_texts(docs):
    out = {}
    d = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in fingerprint(docs.where("doc_id is not null"), lexicon(docs)).collect():
        assert out.setdefault(d[r.doc_id], r.fingerprint) == r.fingerprint
