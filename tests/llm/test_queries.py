import re

import duckdb
import pytest

import __spark_entry__
from loomwatch.llm import queries

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select * from ({queries.ORACLE_SQL[name]})")
    assert sorted(c[0] for c in want.description) == columns
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple("" if x is None else str(x) for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want)
