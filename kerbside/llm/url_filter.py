"""URL filtering by association rules.

A URL becomes a set of tokens: words of its host, its registered name, words of its path, keys of its query.  FP-growth mines the token
combinations that occur together with a class (block or allow) in labelled URLs.  Rules that
conclude a class are pruned by confidence, support and lift, and a rule is
dropped if a part of it is as confident.  An inverted index from token
to rules matches them: a URL's tokens lead to rules, and a rule fires when the
URL has all its tokens.  Hand-written rules (host, path) go before mined ones.

Everything is DataFrame functions; judging needs no shuffle.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Class tokens; no URL has a token with this beginning.
BLOCK, ALLOW = "class=block", "class=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A hand-written rule: it fits `host` and its subdomains if the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty if there is none or the url is null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased, user and port included."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule:string, verdict:string>; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL; empty for null."""
    host, path = host_of(url), path_of(url)
    labels = F.split(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"\.")
    name = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    words = F.split(host, r"[^\p{L}]+")
    parts = F.split(F.lower(path), r"[^\p{L}]+")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(tag + "="), x))

    own = F.concat(tagged("name", F.array(name)), tagged("word", words), tagged("path", parts), tagged("key", keys))
    return F.array_sort(F.array_distinct(F.coalesce(own, F.array().cast("array<string>"))))


@dataclass(frozen=True)
class Mined:
    """A mined rule: these tokens conclude the verdict."""

    verdict: str
    tokens: tuple[str, ...]
    confidence: float
    support: float
    lift: float


def prune(rules: list[Mined]) -> list[Mined]:
    """The rules of which no part alone is as confident of the same verdict; those that raise its share most come first."""
    kept: list[Mined] = []
    parts: dict[tuple[str, str], list[tuple[frozenset[str], float]]] = {}  # by verdict and first token
    for r in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.verdict)):
        items = frozenset(r.tokens)
        if not any(c >= r.confidence and p < items for t in r.tokens for p, c in parts.get((r.verdict, t), ())):
            kept.append(r)
            parts.setdefault((r.verdict, min(r.tokens)), []).append((items, r.confidence))
    return sorted(kept, key=lambda r: (-r.lift, -r.confidence, -r.support, r.tokens, r.verdict))


def together(rows: DataFrame, least: float) -> list[list[str]]:
    """Groups of tokens that always occur together, among those in `least` rows of `rows` (items) or more.

    Tokens are told apart by two sums of hashes of the rows that have them.
    """
    hashes = [F.xxhash64("items", F.lit(k)).cast("decimal(20,0)").alias(f"h{k}") for k in (0, 1)]
    each = rows.select(*hashes, F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    found = each.where((F.col("n") >= least) & ~F.col("token").isin(BLOCK, ALLOW)).groupBy("n", "h0", "h1").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return [r.tokens for r in found.where(F.size("tokens") > 1).collect()]


def undominated(rules: DataFrame) -> DataFrame:
    """Rules (tokens, verdict, confidence, ...) without those of which a part, one token shorter, is as confident of the same verdict."""
    shorter = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("gone"))
    shorter = shorter.select(F.col("tokens").alias("whole"), "verdict", "confidence", F.array_except("tokens", F.array("gone")).alias("tokens"))
    part = rules.select("tokens", "verdict", F.col("confidence").alias("part"))
    worse = shorter.join(part, ["tokens", "verdict"]).where("part >= confidence").select(F.col("whole").alias("tokens"), "verdict").distinct()
    return rules.join(worse, ["tokens", "verdict"], "left_anti")


def mine(labelled: DataFrame, url: str = "url", blocked: str = "blocked", *, min_support: float = 0.002, min_count: int = 25, min_confidence: float = 0.6, min_lift: float = 1.02) -> list[Mined]:
    """Pruned rules from all labelled URLs.

    Rows with a null label teach nothing; a null url has the class token alone;
    repeated rows count as often as they come.
    A rule needs `min_support` of all labelled rows and `min_count` of them, so
    that the number of tokens in rules is at most (tokens of a URL) /
    min_support whatever the input.

    Tokens that always occur together are mined as one, since all combinations
    of them are as confident as one alone, and each of them stands in for that
    one in the rules found.  Rules that a part makes redundant go before the
    driver reads any.
    """
    rows = labelled.where(F.col(blocked).isNotNull()).select(F.concat(tokens(F.col(url)), F.array(F.when(F.col(blocked), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))).alias("items"))
    n = rows.count()
    if not n:
        return []
    support = max(min_support, min(1.0, min_count / n))
    groups = {g[0]: g for g in together(rows, support * n * (1 - 1e-9))}
    others = [t for g in groups.values() for t in g[1:]]
    if others:
        rows = rows.select(F.filter("items", lambda t: ~t.isin(others)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.col("lift") >= min_lift) & (F.col("support") >= support))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("verdict"), "confidence", "support", "lift")
    rules = materialize(rules, "rules")
    found = [Mined(r.verdict.partition("=")[2], tuple(sorted(t)), r.confidence, r.support, r.lift) for r in undominated(rules).collect() for t in product(*(groups.get(t, [t]) for t in r.tokens))]
    return prune(found)


def fired(url_tokens: Column, rules: list[Mined]) -> Column:
    """The number of the first mined rule that fires, with its confidence, as struct<confidence:double, rule:int>; null if none does.

    The index is one literal map from token to rules.  A rule stands under the
    one of its tokens that fewest rules have, with its other tokens, so that a
    URL meets few rules that don't fire.
    """
    if not rules:
        return F.lit(None).cast("struct<confidence:double,rule:int>")
    common = Counter(t for r in rules for t in r.tokens)
    postings: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        first = min(r.tokens, key=lambda t: (common[t], t))
        postings.setdefault(first, []).append({"r": k, "c": r.confidence, "t": [t for t in r.tokens if t != first]})
    kind = "array<struct<r:int,c:double,t:array<string>>>"
    index = F.from_json(F.lit(json.dumps(postings)), f"map<string,{kind}>")
    met = F.flatten(F.transform(url_tokens, lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast(kind))))
    whole = F.filter(met, lambda h: F.forall(h["t"], lambda t: F.array_contains(url_tokens, t)))
    # rules are numbered by falling lift, so the least number is the best
    best = F.array_min(F.transform(whole, lambda h: F.struct(h["r"].alias("rule"), h["c"].alias("confidence"))))
    return F.when(best.isNotNull(), F.struct(best["confidence"].alias("confidence"), best["rule"].alias("rule")))


def judge(pages: DataFrame, rules: list[Rule], mined: list[Mined], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict, mined_rule and confidence.

    The verdict is that of the longest hand-written rule that fits, else that
    of the mined rule that fires and raises its verdict's share most, else allow.  A null url, or one without `://`, has an
    empty host and path and is judged by its tokens, none, as allowed.
    Columns of these names in `pages` are replaced; all else stays, repeated
    rows too; urls of any length are read whole.
    """
    verdicts = F.array(*(F.lit(r.verdict) for r in mined)) if mined else F.array().cast("array<string>")
    names = F.array(*(F.lit(" ".join(r.tokens)) for r in mined)) if mined else F.array().cast("array<string>")
    out = pages.drop("host", "path", "rule", "verdict", "mined_rule", "confidence", "_hand", "_mined", "_tokens")
    out = out.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn("_hand", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("_tokens", tokens(F.col(url)))
    out = out.withColumn("_mined", fired(F.col("_tokens"), mined)).drop("_tokens")
    verdict = F.coalesce("_hand.verdict", F.get(verdicts, F.col("_mined.rule")), F.lit("allow"))
    return out.withColumns({"rule": F.col("_hand.rule"), "verdict": verdict, "mined_rule": F.get(names, F.col("_mined.rule")), "confidence": F.col("_mined.confidence")}).drop("_hand", "_mined")
