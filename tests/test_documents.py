"""Documents that queries write don't grow with the table."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from kerbside.plans import operator_queries


@pytest.mark.parametrize("name", ["label_documents", "xml_frames", "map_layer"])
def test_documents_are_bounded(spark, tmp_path, monkeypatch, name):
    """Of tables of twice the keys come twice as many documents, none of them larger, and the same rows of each."""
    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(operator_queries, "STRETCH", 2_000)
    sizes = []
    for copies in (1, 2):
        for t, keys in (("lineitem", "l_orderkey"), ("supplier", "s_suppkey")):
            rows = spark.read.parquet(f"{small}/{t}.parquet")
            more = [rows.withColumn(keys, F.col(keys) + 4_000 * k) for k in range(copies)]
            (more[0] if copies == 1 else more[0].unionByName(more[1])).coalesce(1).write.parquet(f"{tmp_path}/{copies}/{t}.parquet")
        monkeypatch.setattr(operator_queries, "_fresh", lambda spark, copies=copies: f"{tmp_path}/{copies}/out")
        n = operator_queries.QUERIES[name](spark, f"{tmp_path}/{copies}").count()
        files = [os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{copies}/out/part-*")]
        sizes.append((n, max(files), sum(s > 0 for s in files)))
    (n1, most1, files1), (n2, most2, files2) = sizes
    assert n2 == 2 * n1 and files2 == 2 * files1
    assert most2 < 1.1 * most1
