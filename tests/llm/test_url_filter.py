import itertools
import random

import pytest
from pyspark.sql import functions as F

from kerbside.llm.queries import URL_RULES, op1_url_filter
from kerbside.llm.url_filter import Mined, fired, judge, mine, prune, tokens

URLS = [
    ("https://www.example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("HTTPS://EXAMPLE.com/fr#f", "example.com", "/fr", "com/", "allow"),
    ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
    ("http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?/en/", "example.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://É.Org/é?://", "É.org", "/é", None, "allow"),
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_hand_written_rules(spark):
    df = spark.createDataFrame([(k, u, "mine") for k, (u, *_) in enumerate(URLS)], "page_id long, url string, verdict string")
    out = {r.page_id: r for r in judge(df, URL_RULES, []).collect()}
    for k, (u, *want) in enumerate(URLS):
        assert [out[k].host, out[k].path, out[k].rule, out[k].verdict] == want, u


def test_all_pages_against_plain_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    out = {r.page_id: r for r in op1_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == len(pages)
    for p in pages:
        host, path, rule, verdict = plain(p.url, URL_RULES)
        assert (out[p.page_id].host, out[p.page_id].path, out[p.page_id].rule) == (host, path, rule)
        assert out[p.page_id].verdict == verdict if verdict else out[p.page_id].verdict in ("allow", "block")


def test_mined_rules_find_what_the_labels_say(spark):
    rows = [(k, f"http://{'cheap-pills' if k % 4 == 0 else 'garden'}.example.org/{'en' if k % 2 else 'de'}/{k}", k % 4 == 0) for k in range(400)] + [(900, "http://garden.example.org/en/1", None), (901, None, False)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    rules = mine(df)
    out = judge(df, [], rules).collect()
    assert all(r.verdict == ("block" if r.blocked else "allow") for r in out)
    assert all(len(r.tokens) == 1 for r in rules if r.verdict == "block")


def test_fixed_tokens_of_one_host_cost_no_other_its_rules(spark):
    """A third of the rows are of a host with many tokens that are the same in each of its URLs; the rules of small hosts stay."""
    path = "/".join(f"part{chr(97 + k)}" for k in range(12))
    rows = [(k, f"http://hot.example.org/{path}/{k}", k % 10 != 0) for k in range(2000)]
    rows += [(2000 + k, f"http://s{'abcdefghij'[k % 10]}.example.net/{k}", k % 10 == 3) for k in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    rules = mine(df)
    assert ("block", ("word=sd",)) in {(r.verdict, r.tokens) for r in rules}
    assert {r.tokens[0] for r in rules if r.verdict == "block" and len(r.tokens) == 1} >= {f"path=part{chr(97 + k)}" for k in range(12)}
    assert len(rules) < 200
    out = {r.page_id: r.verdict for r in judge(df, [], rules).collect()}
    assert all(out[k] == ("block" if k < 2000 or k % 10 == 3 else "allow") for k in range(6000))


def test_matching_is_that_of_the_sets(spark):
    rules = [Mined("block", ("a", "b"), 0.9, 0.1, 3.0), Mined("block", ("c",), 0.8, 0.1, 2.0), Mined("allow", ("a",), 0.7, 0.1, 1.1)]
    sets = [[], ["a"], ["a", "b"], ["b"], ["b", "c"], ["a", "b", "c"]]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k long, t array<string>")
    got = [r.f.rule if r.f else None for r in df.select("k", fired(F.col("t"), rules).alias("f")).orderBy("k").collect()]
    assert got == [next((i for i, r in enumerate(rules) if set(r.tokens) <= set(s)), None) for s in sets]


def test_prune():
    kept = prune([Mined("block", ("a",), 0.8, 0.2, 2.0), Mined("block", ("a", "b"), 0.8, 0.1, 2.0), Mined("block", ("a", "c"), 0.9, 0.1, 2.2), Mined("allow", ("a", "b"), 0.7, 0.1, 1.1)])
    assert [(r.verdict, r.tokens) for r in kept] == [("block", ("a", "c")), ("block", ("a",)), ("allow", ("a", "b"))]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "page_id long, url string, blocked boolean")
    assert mine(df) == [] and judge(df, URL_RULES, []).collect() == []


@pytest.mark.parametrize("url,want", [(None, []), ("http://u@Big-Shop.co.uk:80/a-1/b?k=1&j", ["key=j", "key=k", "name=big-shop.co.uk", "path=a", "path=b", "word=big", "word=co", "word=shop", "word=u", "word=uk"])])
def test_tokens(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(tokens(F.col("url"))).first()[0] == want


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "http://a.example.net/es/x", "h", "p", "r", "v", 0.5)] * 3 + [(None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, confidence double")
    out = judge(pages, URL_RULES, []).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in out) == [(0, "", "", None, "allow")] + [(1, "a.example.net", "/es/x", "net/es/", "block")] * 3


def test_mined_rules_are_those_of_counted_sets(spark):
    """All sets of up to three tokens counted by loops."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        host, part, key = rng.choice("abc"), rng.choice("xyz"), rng.choice("pq")
        rows.append((k, f"http://{host * 3}.example.org/{part * 3}?{key}=1", rng.random() < (0.9 if (host, part) == ("a", "x") else 0.7 if key == "q" and host == "b" else 0.3)))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    held = [(frozenset(r.t), r.blocked) for r in df.select(tokens(F.col("url")).alias("t"), "blocked").collect()]
    n = len(held)
    share = {v: sum(b == (v == "block") for _, b in held) / n for v in ("block", "allow")}
    for r in mine(df, min_support=0.02, min_count=10):
        having = [b for t, b in held if set(r.tokens) <= t]
        right = sum(b == (r.verdict == "block") for b in having)
        assert r.confidence == pytest.approx(right / len(having)) and r.support == pytest.approx(right / n) and r.lift == pytest.approx(right / len(having) / share[r.verdict])
        assert right >= max(10, 0.02 * n) and r.confidence >= 0.6 and r.lift >= 1.02
    best = {}
    for size in (1, 2, 3):
        for tokens_ in {frozenset(c) for t, _ in held for c in itertools.combinations(sorted(t), size)}:
            having = [b for t, b in held if tokens_ <= t]
            for v in ("block", "allow"):
                right = sum(b == (v == "block") for b in having)
                if right >= 10 and right / len(having) >= 0.6 and right / len(having) / share[v] >= 1.02:
                    best[v] = max(best.get(v, 0.0), right / len(having))
    found = mine(df, min_support=0.02, min_count=10)
    assert {v: max(r.confidence for r in found if r.verdict == v) for v in best} == pytest.approx(best)
