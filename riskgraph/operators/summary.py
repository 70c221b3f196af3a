"""Dataset profile and case distributions (global aggregates, map-side combined)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import labels as L
from riskgraph.operators.metrics import feature_columns, with_labels


def dataset_profile(nodes: DataFrame, edges: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Node count, directed edge count, time steps (count, min, max), feature counts.

    ``steps``: (id, time_step) of ``nodes``, row for row, where they are had more cheaply; so with ``summary_record``.
    """
    n_feat = len(feature_columns(nodes))
    node_stats = (nodes if steps is None else steps).agg(
        F.count(F.lit(1)).alias("node_count"),
        F.countDistinct("time_step").alias("time_step_count"),
        F.min("time_step").alias("time_step_min"),
        F.max("time_step").alias("time_step_max"),
    )
    edge_count = edges.agg(F.count(F.lit(1))).scalar()
    return node_stats.select(
        "node_count", edge_count.alias("directed_edge_count"), "time_step_count", "time_step_min", "time_step_max",
        F.lit(n_feat + 2).alias("raw_feature_count"), F.lit(n_feat).alias("anonymous_feature_count"),
    )


def label_distribution(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes per label name (no label row -> unknown)."""
    return with_labels(nodes.select("id"), labels).groupBy("label_name").agg(F.count(F.lit(1)).alias("node_count"))


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """2 * E / N, rounded to 4 decimals."""
    e = edges.agg(F.count(F.lit(1))).scalar()
    return nodes.agg(F.count(F.lit(1)).alias("n")).select(
        e.alias("directed_edge_count"), F.col("n").alias("node_count"),
        F.round(2.0 * e / F.col("n"), 4).alias("average_directed_degree"))


def case_distributions(cases: DataFrame) -> DataFrame:
    """(dimension, value, case_count) by public risk band and by display label."""
    x = cases.select(
        F.inline(F.array(
            F.struct(F.lit("riskBand").alias("dimension"), L.public_band(F.col("risk_level")).alias("value")),
            F.struct(F.lit("demoLabel").alias("dimension"), L.display_label(F.col("label_name")).alias("value")),
        )))
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("case_count"))


def _counts_map(counts: DataFrame, key: str, value: str):
    """A few counted values (labels, bands) as one map."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))).scalar()


def summary_record(nodes: DataFrame, edges: DataFrame, labels: DataFrame, components: DataFrame, cases: DataFrame,
                   steps: DataFrame | None = None) -> DataFrame:
    """A12 to A15 as one nested record (one row); ``components`` from ``graph.component_summary``."""
    profile = dataset_profile(nodes, edges, steps)
    nodes = nodes if steps is None else steps
    by = case_distributions(cases)
    one = lambda c: components.select(c).scalar()
    return profile.select(
        F.struct(F.col("node_count").alias("nodeCount"), F.col("directed_edge_count").alias("directedEdgeCount"),
                 F.col("time_step_count").alias("timeStepCount"), F.array("time_step_min", "time_step_max").alias("timeStepRange"),
                 F.col("raw_feature_count").alias("rawFeatureCountIncludingTxIdAndTimeStep"),
                 F.col("anonymous_feature_count").alias("anonymousFeatureCount")).alias("keyFactors"),
        _counts_map(label_distribution(nodes, labels), "label_name", "node_count").alias("labelDistribution"),
        F.struct(F.col("directed_edge_count").alias("directedEdgeCount"),
                 average_degree(nodes, edges).select("average_directed_degree").scalar().alias("averageDirectedDegreeApprox"),
                 one("component_count").alias("weakComponentCount"), one("largest_component_size").alias("largestWeakComponentSize"),
                 one("singleton_count").alias("singleNodeComponentCount")).alias("graphSummary"),
        F.struct(cases.agg(F.count(F.lit(1))).scalar().alias("maxDemoCases"),
                 _counts_map(by.where("dimension = 'riskBand'"), "value", "case_count").alias("riskBandDistribution"),
                 _counts_map(by.where("dimension = 'demoLabel'"), "value", "case_count").alias("demoLabelDistribution")).alias("generatedDemoCaseSummary"))
