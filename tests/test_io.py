from pyspark.sql import functions as F

from riskgraph import sinks
from riskgraph.session import scratch_path
from riskgraph.sources import files as FS


def test_csv_inputs_round_trip_and_discovery(spark, fixture_graph):
    g = fixture_graph
    root = scratch_path(spark, "io_test")
    g.labels.select(F.col("id").alias("txId"), F.col("class_raw").alias("class")).write.option("header", "true").csv(
        f"{root}/a/{FS.INPUT_NAMES['classes']}")
    g.edges.select(F.col("src").alias("txId1"), F.col("dst").alias("txId2")).write.option("header", "true").csv(
        f"{root}/b/{FS.INPUT_NAMES['edges']}")
    g.nodes.select("id", F.col("time_step").cast("double"), "f_001", "f_002", "f_003").write.csv(
        f"{root}/b/c/{FS.INPUT_NAMES['features']}")
    found = {r.key: r.path for r in FS.discover(spark, root).collect()}
    assert set(found) == {"classes", "edges", "features"}
    labels = FS.read_labels(spark, found["classes"])
    assert {(r.id, r.label_name) for r in labels.collect()} == {(r.id, r.label_name) for r in g.labels.collect()}
    edges = FS.read_edges(spark, found["edges"])
    assert sorted(tuple(r) for r in edges.collect()) == sorted(tuple(r) for r in g.edges.collect())
    nodes = FS.read_nodes(spark, found["features"], n_features=3)
    assert nodes.count() == 10
    row8 = nodes.where("id = 8").first()
    assert row8.f_002 is None  # NaN / null stay missing after the round trip


def test_json_sink_round_trip(spark):
    df = spark.createDataFrame([(1, "é", [1, 2], {"k": "v"})], "id long, t string, a array<int>, m map<string,string>")
    path = sinks.write_json(df, scratch_path(spark, "json_test"))
    back = FS.read_json_records(spark, path, df.schema)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    csv_path = sinks.write_csv(df, scratch_path(spark, "csv_test"))
    txt = spark.read.option("header", "true").csv(csv_path).first()
    assert txt.a == "[1,2]" and txt.t == "é"
