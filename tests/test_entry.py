import os

import duckdb
import pytest

import __spark_entry__
from lexiloom.plans import registry

SLOW = {"generate_bi_greedy", "generate_bi_greedy_stop", "generate_tri_greedy", "generate_bi_weighted", "generate_tri_weighted"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW | {"generate_bi_greedy", "generate_bi_weighted", "generate_tri_weighted"}))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    rel = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from rel").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
