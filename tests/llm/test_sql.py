"""Queries with an SQL form against DuckDB on the same table."""

import duckdb
import pytest

from riskgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.oracle_sql()[key])
    names = sorted(c[0] for c in want.description)
    frame = queries.QUERIES[key](spark, SF)
    assert sorted(frame.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted(tuple(r[i] for i in order) for r in want.fetchall())
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == rows


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
