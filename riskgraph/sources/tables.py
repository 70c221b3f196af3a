"""Graph inputs derived from the driver's parquet tables.

Orders are transaction nodes.  For each part, an order points to the next
order of that part (by order date, then order key), which gives a directed
transaction graph of the same shape as a transaction edge list.  Labels and
three numeric features are derived from order attributes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_ORIGIN = "1995-01-01"
STEP_DAYS = 50


@dataclass(frozen=True)
class GraphInputs:
    nodes: DataFrame   # id long, time_step int, f_001.. double
    edges: DataFrame   # src long, dst long (directed, multi-edges kept)
    labels: DataFrame  # id long, class_raw string, label_name string
    node_ids: DataFrame | None = None  # the ids of ``nodes``, row for row, where they are had more cheaply

    nodes_among: Callable[[DataFrame], DataFrame] | None = None  # rows of ``nodes`` with an id of a small (id) table, had more cheaply

    node_steps: DataFrame | None = None  # (id, time_step) of ``nodes``, row for row, where they are had more cheaply

    @property
    def ids(self) -> DataFrame:
        return self.nodes.select("id") if self.node_ids is None else self.node_ids

    @property
    def steps(self) -> DataFrame:
        return self.nodes.select("id", "time_step") if self.node_steps is None else self.node_steps

    def nodes_of(self, few: DataFrame) -> DataFrame:
        """The node rows whose id stands in ``few``."""
        few = few.select("id")
        return self.nodes.join(few, "id", "left_semi") if self.nodes_among is None else self.nodes_among(few)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges: each order points to the next order of the same part.

    The successor is found with ``lead_within``, which does not hold a hot part
    in one task.  Ties on (date, order key) only occur between rows of the same
    order, so the multiset of (src, dst) pairs is fixed.
    """
    from riskgraph.operators.sequence import lead_within

    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey).select("l_partkey", "o_orderdate", "l_orderkey")
    nxt = lead_within(rows, "l_partkey", ["o_orderdate", "l_orderkey"], "l_orderkey", "dst", counted=li.select("l_partkey"))
    return nxt.select(F.col("l_orderkey").alias("src"), "dst").where(F.col("dst").isNotNull())


def _time_step():
    """The 50-day step of an order."""
    return (F.floor(F.datediff(F.to_date("o_orderdate"), F.lit(STEP_ORIGIN)) / STEP_DAYS) + 1).cast("int")


def order_nodes(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """Node table: id, time_step (50-day steps), three features; with ``among``, a small (id) table, of those orders alone."""
    lines, orders = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    if among is not None:  # looked up in both tables, before lines are grouped
        lines = lines.join(among.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
        orders = orders.join(among.select(F.col("id").alias("o_orderkey")), "o_orderkey", "left_semi")
    li = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    orders = orders.select("o_orderkey", _time_step().alias("time_step"), (F.col("o_totalprice") / 100000).alias("f_001"))
    return (
        orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("id"),
            "time_step",
            "f_001",
            (F.coalesce(F.col("q"), F.lit(0.0)) / 50).alias("f_002"),
            (F.coalesce(F.col("d"), F.lit(0.0)) * 10).alias("f_003"),
        )
    )


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows (id, class_raw) with class "1" risky, "2" clean, else unknown."""
    orders = read_table(spark, sf_dir, "orders")
    class_raw = (
        F.when(
            (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
            & (F.col("o_totalprice") >= 350000), F.lit("1"))
        .when(F.col("o_orderstatus") == "O", F.lit("2"))
        .otherwise(F.lit("unknown"))
    )
    from riskgraph.functions.labels import decode_class

    return orders.select(F.col("o_orderkey").alias("id"), class_raw.alias("class_raw")).withColumn(
        "label_name", decode_class(F.col("class_raw")))


def load_graph(spark: SparkSession, sf_dir: str, materialize_edges: bool = True) -> GraphInputs:
    """Graph inputs from the driver tables.  The derived edge list is written
    once to the shared folder (it stands for an edge file and is read by many
    plans: degrees, adjacency branches, components)."""
    from riskgraph.session import materialize

    edges = order_edges(spark, sf_dir)
    if materialize_edges:
        edges = materialize(edges, "order_edges")
    return GraphInputs(
        nodes=order_nodes(spark, sf_dir),
        edges=edges,
        labels=order_labels(spark, sf_dir),
        node_ids=read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")),  # each order is one node
        nodes_among=lambda few: order_nodes(spark, sf_dir, few),
        node_steps=read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _time_step().alias("time_step")),
    )


def load_corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance page table (source_id, page, text) from ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("source_id"),
        F.col("doc_id").cast("long").alias("page"),
        F.col("text"),
    )
