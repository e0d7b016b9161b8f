"""Documents to training sequences: language ID, near duplicates, benchmark, personal data, packing.

`run` applies STAGES to the table documents.  Each stage works on all that the
one before it kept, and its decisions take effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import materialize, table
from kerbside.llm.decontaminate import contaminated
from kerbside.llm.language_id import identify, learn
from kerbside.llm.minhash_dedup import near_duplicates
from kerbside.llm.packing import pack
from kerbside.llm.pii import mask_pii

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; text that is null or has no letter goes.  A null lang is filled with the prediction.  Where nothing was learned all text with a letter stays, as `und`."""
    model = learn(docs)
    found = identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    return found.where(F.col("lang_pred") != "und" if model.languages else F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (a document without an id only where none of its group has one).

    Documents count with their own texts, so those of one id with unlike texts
    all stay; of rows equal in id and text one stays.
    """
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    keyed = docs.select(*COLUMNS, key.alias("_key"))
    found = near_duplicates(keyed, keep=("_key",))
    first = found.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "_key")).alias("first"))
    kept = first.select("first._key").unionByName(found.where("group_id is null").select("_key"))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return leaks.where("not leaked").select(*COLUMNS)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return mask_pii(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("minhash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", privacy),
    ("best-fit packing", packing),
]

#: No stage of these can be written in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
