"""Ids of any type: texts, null and repeated ones."""

import public_tokenizers
import pytest

from kerbside.llm.decontaminate import contaminated
from kerbside.llm.language_id import identify, learn
from kerbside.llm.minhash_dedup import near_duplicates
from kerbside.llm.packing import pack
from kerbside.llm.pii import find_pii
from kerbside.llm.token_counts import token_counts

ROWS = [("d0", "one two three four five six seven"), ("d1", "One two three four five six seven"), (None, "one two three four five six seven"), ("", "mail a@b.cc"), ("d1", None)]


@pytest.fixture(scope="module")
def named(spark):
    """Ids are texts; names of results are taken by other columns."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, None) for r in ROWS], "doc_id string, text string, length long, n_tokens long, spans string, item_ids string, start long, base string")


def test_packing(named):
    out = pack(named, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in ROWS) and len({r.sequence_id for r in out}) == 1


def test_near_duplicates(named):
    out = near_duplicates(named).collect()
    assert {(r.doc_id, r.component_id) for r in out if r.n_shingles == 3} == {("d0", "d0"), ("d1", "d0"), (None, "d0")}


def test_decontamination(spark, named):
    items = spark.createDataFrame([("b", "two three four five six"), ("", "three four five six seven"), (None, "four five six seven"), ("c", "no such text at all here")], "item_id string, text string")
    out = {r.doc_id: r.item_ids for r in contaminated(named, items).collect() if r.n_items}
    assert out == {"d0": [None, "", "b"], "d1": [None, "", "b"], None: [None, "", "b"]}


def test_the_others(named):
    assert find_pii(named).count() == identify(named, learn(named.withColumnRenamed("base", "lang"))).count() == token_counts(named, public_tokenizers.path("piece_bpe_32k.model")).count() == len(ROWS)
