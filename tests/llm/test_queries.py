import glob
import os

import duckdb
import pytest

from kerbside.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    answer = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in answer.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(answer.fetchall())


def test_every_query_says_what_it_does():
    assert len(QUERIES) == 13 and all(q.__doc__ for q in QUERIES.values())
