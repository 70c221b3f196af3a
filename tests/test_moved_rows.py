"""What is written and moved: rows that no later step needs are not, and the results are those of the plain way."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from riskgraph.operators import graph as G
from riskgraph.operators import sampling as S
from riskgraph.operators.metrics import features_of
from riskgraph.plans import catalog
from riskgraph.session import checkpoint_dir
from riskgraph.sources.tables import load_graph


def _written(spark, name):
    return set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/tables/{name}-*"))


def _tables(spark, path, hot=False):
    day = lambda i: dt.datetime(1995, 1, 1) + dt.timedelta(days=i * 37 % 400)
    orders = [(i, "O" if i % 3 else "F", 400000.0 + i, day(i), "1-URGENT") for i in range(300)]
    lines = [(i, 1 if hot else (i * 7 + j) % 40, float(j + 1), 0.01 * j) for i in range(300) for j in range(i % 4)]
    spark.createDataFrame(orders + orders[:2], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                          "o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    rows = sorted((p, day(o), o) for o, p, _, _ in lines for _ in range(2 if o < 2 else 1))
    return sorted((a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_edges_without_hot_parts_write_no_rows(spark, tmp_path):
    want = _tables(spark, str(tmp_path))
    before = _written(spark, "lead_rows")
    g = load_graph(spark, str(tmp_path))
    assert sorted(map(tuple, g.edges.collect())) == want
    assert _written(spark, "lead_rows") == before


def test_edges_of_one_hot_part(spark, tmp_path):
    want = _tables(spark, str(tmp_path), hot=True)
    before = _written(spark, "lead_sorted")
    assert sorted(map(tuple, load_graph(spark, str(tmp_path)).edges.collect())) == want
    assert len(_written(spark, "lead_sorted") - before) == 1


def test_nodes_of_a_few_orders(spark, tmp_path):
    _tables(spark, str(tmp_path))
    g = load_graph(spark, str(tmp_path))
    few = spark.createDataFrame([(0,), (7,), (8,), (8,), (None,), (999,)], "id long")
    got = sorted(map(tuple, features_of(few, g.nodes_of(few)).collect()))
    assert got == sorted(map(tuple, features_of(few, g.nodes).collect())) and [r[0] for r in got] == [0, 0, 7, 8]


def test_risky_ids_of_a_sample_are_those_it_reaches(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "src long, dst long")
    risky = spark.range(0, 500, 2).select("id")
    before = _written(spark, "risky_ids")
    sources = spark.createDataFrame([(10,), (11,), (9999,)], "id long")
    got = {r.id: (r.one_hop_neighbor_count, r.one_hop_risky_count, r.two_hop_neighbor_count, r.two_hop_risky_count)
           for r in G.exposure(sources, G.adjacency(edges), risky).collect()}
    assert got == {10: (2, 0, 2, 2), 11: (2, 2, 2, 0), 9999: (0, 0, 0, 0)}
    (path,) = _written(spark, "risky_ids") - before
    assert {r.id for r in spark.read.parquet(path).collect()} == {8, 10, 12}


def test_early_draws_hold_the_first_of_every_stratum(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 4000 != 3, F.col("id")).alias("id"),
                                   F.when(F.col("id") % 5 != 0, F.when(F.col("id") < 7, "few").otherwise("many")).alias("kind"))
    df = df.unionByName(df.where("id < 3"))
    early = S.early_draws(df, ["kind"], 10, [1, 2])
    assert 30 < early.count() < 300
    rows = df.withColumn("d1", S.draw_key(1)).withColumn("d2", S.draw_key(2)).collect()
    for seed in (1, 2):
        want = []
        for kind in (None, "few", "many"):
            keys = [(r[f"d{seed}"] or "", -1 if r.id is None else r.id) for r in rows if r.kind == kind]
            want += [(kind or "", i) for _, i in sorted(keys)[:10]]
        got = [(r.kind or "", -1 if r.id is None else r.id) for r in S.sample_stratified(df, ["kind"], 10, seed).collect()]
        assert sorted(got) == sorted(want)


def test_full_run_scores_the_nodes_once(spark):
    catalog._memo.clear()
    before = _written(spark, "node_metrics")
    rows = {r.output: r.rows for r in catalog.queries()["pipeline_run"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["drafts from the model"] > 0 and len(set(rows.values()) - {rows["drafts from the model"]}) == 1
    assert len(_written(spark, "node_metrics") - before) == 1
