"""The queries that have SQL, against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr) == got and got
