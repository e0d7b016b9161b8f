"""The queries opN_<name> of the driver: thin contracts over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .decontaminate import contaminated
from .fingerprints import compare_with_edits, lexicon
from .html_extract import extract
from .importance import resample
from .language_id import held_out, identify, learn
from .minhash_dedup import near_duplicates
from .ngram_lm import score_texts
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import KINDS, find_pii
from .simhash_dedup import simhash_groups
from .token_counts import token_counts
from .url_filter import Rule, judge, mine


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document under a trigram model of those that are not held out."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id") % 7 == 2)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_edits(docs, lexicon(docs))


#: The hand-written rules of the contract.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged.  The method learns from `labels`: a page is bad where the document of its number is of quality 0 or toxic, as the tables have no other labels for pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    judged = judge(pages, URL_RULES, mine(pages.join(labels, "page_id")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return identify(docs, learn(docs.where("not held_out")), keep=("held_out",))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 1,024 tokens in as few sequences as best fit finds."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _joined(spans: str) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and `spans` hold the plain ones and those behind disguises."""
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.col("spans.kind")
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, chosen by id, repeat a stretch of their words to the end; rows without an id stay as they are."""
    h = fold("doc_id")
    parts = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    n = F.size("words")
    parts = parts.withColumn("a", F.when(n > 0, F.col("g") % n))
    parts = parts.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long"))
    word = F.transform(places, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return parts.select("doc_id", F.when(F.col("chosen") & (n > 0), F.concat_ws(" ", word)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of at least four periods in every document, a tenth of which repeat a stretch of their words."""
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance towards the benchmark, and its rank among the twentieth drawn."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its group of near duplicates."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_html_extract": op3_html_extract,
    "op4_decontaminate": op4_decontaminate,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance": op12_importance,
    "op13_simhash_dedup": op13_simhash_dedup,
}

#: CRC-32 of a list of byte values: a table of 256 entries made from its polynomial, then one step a byte.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: SQL expresses runs by all pairs of equal five-word sequences of a text, importance by all n-grams, near duplicates by all pairs of texts that share a shingle.  The other operators' methods it can't, so tests hold those against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""WITH {_CRC_TABLE},
 d AS (SELECT doc_id, {_crc("list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, crc),
 e AS (SELECT *, h // 10 AS g, len(w) AS n FROM d), f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e), k AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
 t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM k),
 five AS (SELECT doc_id, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: hash(array_to_string(w[i + 1:i + 5], ' ')))) AS x FROM t WHERE n >= 6),
 pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM five a JOIN five b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 4),
 isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
 found AS (SELECT doc_id, q AS period, min(i) AS start, count(*) + 4 + q AS length FROM isles GROUP BY doc_id, q, isle HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
 runs AS (SELECT * FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.doc_id = x.doc_id AND y.period < x.period AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
 dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs), out_ AS (SELECT doc_id, list(i) AS gone FROM dropped GROUP BY 1),
 agg AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
 left_ AS (SELECT t.doc_id, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (SELECT coalesce(string_agg(u.word, ' ' ORDER BY u.i), '') FROM (SELECT unnest(w) AS word, unnest(range(n)) AS i) u WHERE NOT list_contains(gone, u.i)) END AS kept FROM t LEFT JOIN out_ USING (doc_id))
 SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
 FROM t LEFT JOIN agg USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
    "op12_importance": rf"""WITH {_CRC_TABLE},
 texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
 w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
 g AS (SELECT side, doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS f FROM w),
 c AS (SELECT side, doc_id, f, count(*) AS n FROM g GROUP BY ALL),
 b AS (SELECT f, {_crc("list_transform(range(strlen(f)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)")} % 10000 AS bucket FROM (SELECT DISTINCT f, hex(f) AS x FROM c), crc),
 n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM c JOIN b USING (f) GROUP BY 1),
 gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
 v AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
 s AS (SELECT w.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS enough, ('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN v USING (doc_id) WHERE side = 0),
 z AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score, enough FROM s),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE enough)
 SELECT z.*EXCLUDE (enough), r.rank FROM z LEFT JOIN r ON r.doc_id = z.doc_id AND r.rank <= 5 * (SELECT count(*) FROM z WHERE enough) // 100""",
    "op10_minhash_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
 e AS (SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS h FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
 SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id""",
}
