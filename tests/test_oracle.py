"""Differential check of a subset of registered queries against DuckDB on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem documents conversations".split()
KEYS = ["scored_nodes", "threshold_wide", "exposure_full", "graph_components", "sample_cases", "review_queue",
        "rag_topk", "evidence_text", "case_flat", "sample_stratified", "rank_nodes", "src_nodes"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    df = E.queries()[key](spark, SF)
    sp = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(sp, df.columns) == _norm(res.fetchall(), dcols)


def test_responses_of_every_assistant_turn(spark, con, tmp_path):
    key = "src_responses_turns"
    got = [tuple(r) for r in E.queries()[key](spark, SF).collect()]
    assert len(got) == con.execute("SELECT count(*) FROM conversations WHERE role = 'assistant'").fetchone()[0]
    assert sorted(got) == sorted(con.execute(E.oracle_sql()[key]).fetchall())
    turns = [(1, 0, "user", "{}"), (1, 1, "assistant", '{"risk_summary": "s", "x": 1}'), (1, 2, "assistant", "[1]"), (2, 1, "assistant", None),
             (2, 2, "assistant", '{"risk_summary": null}'), (2, 3, "assistant", '{"cut')]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    other = duckdb.connect()
    other.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = [(1, 1, True, "s"), (1, 2, False, None), (2, 1, False, None), (2, 2, True, None), (2, 3, False, None)]
    assert sorted(tuple(r) for r in E.queries()[key](spark, str(tmp_path)).collect()) == want == sorted(other.execute(E.oracle_sql()[key]).fetchall())
