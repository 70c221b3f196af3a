"""Node metrics: labels, degrees, time-step activity, ratio and intensity.

All column expressions; the only shuffles are the degree aggregation (map-side
combined, so a hub id is pre-aggregated per partition) and the joins on id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph import config as C


def feature_columns(nodes: DataFrame) -> list[str]:
    return [c for c in nodes.columns if c.startswith("f_")]


def degree_counts(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) from one pass over the edges; multi-edges count."""
    both = edges.select(
        F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e")
    ).select("e.*")
    return both.groupBy("id").agg(
        F.sum("o").cast("long").alias("out_degree"),
        F.sum("i").cast("long").alias("in_degree"),
    )


def time_step_counts(nodes: DataFrame) -> DataFrame:
    """(time_step, time_step_activity): nodes per step."""
    return nodes.groupBy("time_step").agg(F.count(F.lit(1)).alias("time_step_activity"))


def _feature(name: str) -> Column:
    """A feature as double, NaN as NULL."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def intensity_expr(cols: Sequence[Column]) -> Column:
    """Mean of absolute values of the given features, nulls skipped; NULL if all null."""
    if not cols:
        return F.lit(0.0)
    total = None
    present = None
    for c in cols:
        a = F.coalesce(F.abs(c), F.lit(0.0))
        n = c.isNotNull().cast("int")
        total = a if total is None else total + a
        present = n if present is None else present + n
    return F.when(present > 0, total / present)


def out_in_ratio(out_deg: Column, in_deg: Column) -> Column:
    return out_deg / (in_deg + F.lit(C.EPSILON))


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join node rows with their label; no label row -> "unknown"."""
    lab = labels.select("id", "label_name")
    return nodes.join(lab, "id", "left").withColumn(
        "label_name", F.coalesce(F.col("label_name"), F.lit("unknown")))


def node_metrics(nodes: DataFrame, edges: DataFrame, labels: DataFrame,
                 intensity_features: int = C.INTENSITY_FEATURES) -> DataFrame:
    """Id, time_step, label_name, degrees, ratio, intensity, activity.

    Intensity is taken while the features are read; the features themselves do
    not travel (``features_of`` brings them back for a few nodes).
    """
    feats = feature_columns(nodes)[:intensity_features]
    base = nodes.select("id", F.col("time_step").cast("int").alias("time_step"),
                        intensity_expr([_feature(c) for c in feats]).alias("anonymized_behavior_intensity"))
    deg = degree_counts(edges)
    steps = time_step_counts(base)
    df = (
        with_labels(base, labels)
        .join(deg, "id", "left")
        .join(steps, "time_step", "left")
    )
    out_d = F.coalesce(F.col("out_degree"), F.lit(0).cast("long"))
    in_d = F.coalesce(F.col("in_degree"), F.lit(0).cast("long"))
    return df.select(
        "id", "time_step", "label_name",
        in_d.alias("in_degree"),
        out_d.alias("out_degree"),
        (in_d + out_d).alias("total_degree"),
        (in_d + out_d).alias("neighbor_complexity"),
        F.col("time_step_activity"),
        out_in_ratio(out_d, in_d).alias("out_in_ratio"),
        "anonymized_behavior_intensity",
    )


def features_of(few: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, features) of the nodes in ``few`` (a small table that the planner checks and broadcasts)."""
    return nodes.join(few.select("id"), "id", "left_semi").select("id", *[_feature(c).alias(c) for c in feature_columns(nodes)])
