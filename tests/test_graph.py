from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.operators import graph as G
from riskgraph.operators.metrics import node_metrics


def _rows(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_degrees_count_multi_edges(fixture_graph):
    g = fixture_graph
    m = _rows(node_metrics(g.nodes, g.edges, g.labels))
    assert (m[1]["out_degree"], m[1]["in_degree"]) == (2, 0)
    assert (m[2]["out_degree"], m[2]["in_degree"]) == (1, 3)
    assert (m[3]["out_degree"], m[3]["in_degree"]) == (2, 1)
    assert (m[4]["out_degree"], m[4]["in_degree"]) == (2, 1)
    assert (m[5]["out_degree"], m[5]["in_degree"]) == (1, 2)
    assert (m[10]["out_degree"], m[10]["in_degree"]) == (0, 0)
    assert m[9]["label_name"] == "unknown"
    assert m[1]["label_name"] == "illicit"
    # out/in ratio keeps the epsilon: in = 0 gives about 1e9 * out
    assert abs(m[1]["out_in_ratio"] - 2 / 1e-9) < 1.0
    # node 8: NaN and null features are skipped in the mean
    assert m[8]["anonymized_behavior_intensity"] == 1.0
    assert abs(m[2]["anonymized_behavior_intensity"] - (2 + 1 + 1) / 3) < 1e-12


def test_exposure_sets_and_distance(fixture_graph):
    g = fixture_graph
    adj = G.adjacency(g.edges)
    risky = G.risky_nodes(g.nodes, g.labels)
    e = _rows(G.exposure(g.nodes.select("id"), adj, risky))
    expect = {
        1: (1, 1, C.DISTANCE_NONE),
        2: (2, 1, C.DISTANCE_1),
        3: (2, 3, C.DISTANCE_2),
        4: (3, 1, C.DISTANCE_NONE),
        5: (2, 2, C.DISTANCE_NONE),
        10: (0, 0, C.DISTANCE_NONE),
    }
    for node, (n1, n2, dist) in expect.items():
        r = e[node]
        assert (r["one_hop_neighbor_count"], r["two_hop_neighbor_count"], r["distance_to_known_illicit_cluster"]) == (n1, n2, dist), node
    # share denominator counts neighbours without a node row (99)
    assert e[3]["two_hop_risk_neighbor_share"] == round(1 / 3, 4)
    assert e[2]["one_hop_risk_neighbor_share"] == 0.5


def test_two_hop_excludes_self_and_one_hop(fixture_graph):
    g = fixture_graph
    adj = G.adjacency(g.edges)
    src = g.nodes.select("id")
    two = G.two_hop_pairs(src, adj)
    assert two.where("a = c").count() == 0
    assert two.join(adj.withColumnRenamed("b", "c"), ["a", "c"], "left_semi").count() == 0
    got = {(r.a, r.c) for r in two.where("a = 5").collect()}
    assert got == {(5, 3), (5, 99)}


def test_components_fixture(fixture_graph):
    g = fixture_graph
    comp, rounds = G.connected_components(g.nodes.select("id"), g.edges)
    c = {r.id: r.component for r in comp.collect()}
    assert c[1] == c[2] == c[3] == c[4] == c[5] == c[99] == 1
    assert c[6] == c[7] == c[8] == c[9] == 6
    assert c[10] == 10
    s = G.component_summary(comp, g.nodes.select("id")).first()
    assert (s.component_count, s.largest_component_size, s.singleton_count) == (3, 5, 1)


def test_components_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, n)], "src long, dst long")
    nodes = spark.range(1, n + 1).select(F.col("id"))
    comp, rounds = G.connected_components(nodes, edges)
    assert comp.where("component <> 1").count() == 0


def _exp_rows(df):
    return sorted((r.id, r.one_hop_neighbor_count, r.one_hop_risky_count, r.two_hop_neighbor_count,
                   r.two_hop_risky_count, r.distance_to_known_illicit_cluster) for r in df.collect())


def test_hub_bitmaps_equal_enumeration_fixture(fixture_graph):
    g = fixture_graph
    adj = G.adjacency(g.edges)
    risky = G.risky_nodes(g.nodes, g.labels)
    ref = _exp_rows(G.exposure(g.nodes.select("id"), adj, risky))
    for theta in (0, 1, 2, 3, 100):
        assert _exp_rows(G.exposure(g.nodes.select("id"), adj, risky, hub_limit=theta)) == ref, theta


def test_hub_bitmaps_equal_enumeration_tables(spark):
    from riskgraph.sources.tables import load_graph

    g = load_graph(spark, "/root/testdata/sf0.001")
    adj = G.adjacency(g.edges)
    risky = G.risky_nodes(g.nodes, g.labels)
    # add a hub joined to every tenth node so that bitmaps overlap light wedges
    hub_edges = g.nodes.where("id % 10 = 0").select(F.lit(999999999).cast("long").alias("src"), F.col("id").alias("dst"))
    adj2 = G.adjacency(g.edges.unionByName(hub_edges))
    ref = _exp_rows(G.exposure(g.nodes.select("id"), adj2, risky))
    for theta in (8, 12):
        assert _exp_rows(G.exposure(g.nodes.select("id"), adj2, risky, hub_limit=theta)) == ref, theta
    assert _exp_rows(G.exposure(g.nodes.select("id"), adj, risky, hub_limit=10)) == _exp_rows(
        G.exposure(g.nodes.select("id"), adj, risky))


def test_hub_with_most_edges(spark):
    """A star whose centre holds nearly every edge: results equal enumeration, and no task of the joins around
    the centre reads its whole neighbourhood."""
    n = 20000
    edges = spark.range(n).select((F.col("id") + 1).alias("src"), F.lit(0).cast("long").alias("dst")).unionByName(
        spark.createDataFrame([(1, 2), (2, 3), (90000, 90001)], "src long, dst long"))
    nodes = spark.range(n + 1).select("id").unionByName(spark.createDataFrame([(90000,), (90001,)], "id long"))
    risky = spark.createDataFrame([(3,), (77,), (0,)], "id long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.files.openCostInBytes": "1m",
            "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        flagged = G._flag_risky(G.materialize(G.adjacency(edges).repartition(8)), "b", G.materialize(risky))
        probe = flagged.select(F.sum("risky").alias("n"))
        probe.collect()
        plan = probe._jdf.queryExecution().executedPlan().toString()
        both = G.materialize(G.adjacency(edges).select(F.col("a").alias("u"), F.col("b").alias("v")).repartition(8))
        low = G._minima(both, F.least("u", "mv"))
        probe2 = both.join(low, "u").select(F.sum("m").alias("n"))
        probe2.collect()
        plan2 = probe2._jdf.queryExecution().executedPlan().toString()
        comp, _ = G.connected_components(nodes, edges)
        sizes = sorted(r["count"] for r in comp.groupBy("component").count().collect())
        got = _exp_rows(G.exposure(nodes, G.adjacency(edges), risky, hub_limit=10))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan and "skew=true" in plan2
    assert sizes == [2, n + 1]
    near = {0: set(range(1, n + 1)), 90000: {90001}, 90001: {90000}} | {i: {0} for i in range(1, n + 1)}
    for a, b in ((1, 2), (2, 3)):
        near[a].add(b)
        near[b].add(a)
    bad = {3, 77, 0}
    want = []
    for a, one in near.items():
        two = set().union(*(near[b] for b in one)) - {a} - one
        r1, r2 = len(one & bad), len(two & bad)
        want.append((a, len(one), r1, len(two), r2))
    assert [r[:5] for r in got] == sorted(want)


def test_own_hub_set_for_every_node(spark):
    """Each node has its own set of hubs: the cost stays in (set, hub, bucket) rows, and counts equal enumeration."""
    hubs, n = 9, 500
    member = F.expr(f"filter(sequence(0, {hubs - 1}), h -> (shiftright(id + 1, cast(h as int)) & 1) = 1)")
    edges = spark.range(n).select((F.col("id") + 100).alias("src"), F.explode(member.cast("array<bigint>")).alias("dst"))
    edges = edges.unionByName(spark.range(n - 1).where("id % 3 = 0").select((F.col("id") + 100).alias("src"), (F.col("id") + 101).alias("dst")))
    nodes = spark.range(hubs).unionByName(spark.range(100, 100 + n)).select("id")
    risky = nodes.where("id % 7 = 0")
    adj = G.adjacency(edges)
    ref = _exp_rows(G.exposure(nodes, adj, risky))
    assert _exp_rows(G.exposure(nodes, adj, risky, hub_limit=40)) == ref
    flagged = G.materialize(adj.withColumn("rb", F.lit(0)))
    sets, unions, nums = G.hub_unions(flagged, spark.range(hubs).select(F.col("id").alias("hub")))
    held = sets.select(*G.SET).distinct().count()
    assert held > n // 2 and unions.count() == held  # one bucket of 32,768 nodes
    got = nums.agg(F.min("num"), F.max("num"), F.count_distinct("num")).first()
    assert tuple(got) == (1, n + hubs, n + hubs)


def test_one_hop_alone(fixture_graph):
    g = fixture_graph
    args = (g.nodes.select("id"), G.adjacency(g.edges), G.risky_nodes(g.nodes, g.labels))
    both = G.exposure(*args)
    one = G.one_hop_exposure(*args)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.select(*one.columns).collect()))


def test_exposure_of_all_nodes_by_lists(spark, monkeypatch):
    """Neighbour lists, wider nodes in rows and hubs as words give the counts of enumeration; no row per pair is written or shuffled
    for narrow nodes, and a hub's bitmap holds only words that have a bit."""
    edges = G.materialize(spark.range(1500).select(F.expr("cast(pow(pmod(xxhash64(id), 997) / 997, 3) * 300 as bigint) - 5").alias("src"),
                                                   F.expr("pmod(xxhash64(id, 1), 400)").alias("dst")))
    nodes = spark.range(-5, 400).select("id")
    risky = nodes.where("id % 7 = 0")
    ref = _exp_rows(G.exposure(nodes, G.adjacency(edges), risky))
    assert _exp_rows(G.exposure(nodes, G.adjacency(edges, 3), risky, hub_limit=1000)) == ref
    monkeypatch.setattr(G, "LIST", 12)
    assert _exp_rows(G.exposure(nodes, G.adjacency(edges), risky, hub_limit=8)) == ref
    adj = G.materialize(G.adjacency(edges).withColumn("rb", F.lit(0)))
    lists = G._lists(adj, "bigint", 4)
    assert lists.count() == adj.select("a").distinct().count()
    hubs = adj.groupBy("a").count().where("count > 8").select(F.col("a").alias("hub"))
    _, unions, _ = G.hub_unions(adj, hubs)
    held = unions.select(F.inline("words")).select(F.sum(F.bit_count("bits")).alias("n"), F.min(F.bit_count("bits")).alias("least")).first()
    assert held["n"] > 0 and held["least"] > 0


def test_one_hop_dealt_in_parts(fixture_graph):
    g = fixture_graph
    risky = G.risky_nodes(g.nodes, g.labels)
    parts = G.one_hop_exposure(g.ids, G.adjacency(g.edges, 3), risky, 3)
    plain = G.one_hop_exposure(g.ids, G.adjacency(g.edges), risky)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, plain.collect()))


def test_components_of_loops_and_missing_rows(spark):
    """Ends without a node row and nodes with only a loop have a component; the look-up of chains waits for single parents."""
    edges = spark.createDataFrame([(5, 5), (1, 2), (2, 1), (3, 2), (9, 9), (8, 4)], "src long, dst long")
    comp, _ = G.connected_components(spark.createDataFrame([(1,), (7,), (9,)], "id long"), edges)
    assert sorted(map(tuple, comp.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (7, 7), (8, 4), (9, 9)]
    assert G._edge_set(edges.toDF("x", "y").union(edges.toDF("x", "y")), 3, "twice").count() == 6


def test_components_shuffle_each_edge_four_times_a_round(spark, tmp_path):
    """A round deals all edges out for the minima of both steps, the small-star join and the distinct edges; the star test reads the minima."""
    written = []
    real = G.materialize
    edges = spark.createDataFrame([(5, 1), (5, 1), (7, 5), (9, 7), (8, 1), (8, 2)], "x long, y long")

    def counting(df, name="table"):
        written.append(name)
        return real(df, name)

    G.materialize = counting
    try:
        low = G._lowest(edges)
        assert not G._is_star_forest(low)
        out = G._star_round(edges, low)
    finally:
        G.materialize = real
    assert written == ["cc_minima", "cc_large", "cc_minima", "cc_edges"]
    assert sorted(map(tuple, low.collect())) == [
        (1, 1, True), (2, 2, True), (5, 1, False), (7, 5, False), (8, 1, False), (9, 7, True)]
    # large-star: (5,1) (5,1) (7,1) (9,5) (8,1) (8,2); small-star on those
    assert sorted(map(tuple, out.collect())) == [(2, 1), (5, 1), (7, 1), (8, 1), (9, 5)]
    star = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (6, 5)], "x long, y long")
    assert G._is_star_forest(G._lowest(star))
    comp, rounds = G.connected_components(spark.range(1, 8), star.toDF("src", "dst"))
    assert rounds == 0 and sorted(map(tuple, comp.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)]


def test_summary_from_steps_alone(spark, fixture_graph):
    """The record is the same from (id, time_step) rows as from the nodes with all their features."""
    from riskgraph.operators import summary as SU

    g = fixture_graph
    cases = spark.createDataFrame([("High", "illicit"), ("Low", "licit")], "risk_level string, label_name string")
    comp = G.component_summary(G.connected_components(g.ids, g.edges)[0], g.ids)
    whole = SU.summary_record(g.nodes, g.edges, g.labels, comp, cases).first()
    assert SU.summary_record(g.nodes, g.edges, g.labels, comp, cases, g.steps).first() == whole
