"""Behavioural peer segments (global P85/P90 cut-offs) and secondary tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.operators.quantiles import quantile_wide


def global_quantiles(metrics_df: DataFrame) -> DataFrame:
    """A3: one row, ``q_<metric>_p85`` and ``q_<metric>_p90`` for the five segment metrics."""
    return quantile_wide(metrics_df, C.SEGMENT_METRICS, C.SEGMENT_PROBS, prefix="q_")


def assign_segments(metrics_df: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """P4 + P5: adds primary_segment and secondary_tag_count.

    The cut-offs are one row of ten numbers (a global aggregate): evaluated
    once and folded into the projection as constants, so there is no join and
    the comparison stays inside whole-stage codegen.
    """
    q = quantiles if quantiles is not None else global_quantiles(metrics_df)
    cut = q.first().asDict()

    def gt(col: str, name: str):
        # a missing cut-off never fires (compares against +inf in the original)
        if cut.get(name) is None:
            return F.lit(False)
        return F.coalesce(F.col(col) > F.lit(float(cut[name])), F.lit(False))

    high = gt("out_degree", "q_out_degree_p90") | gt("anonymized_behavior_intensity", "q_anonymized_behavior_intensity_p90")
    active = (
        gt("total_degree", "q_total_degree_p85")
        | gt("neighbor_complexity", "q_neighbor_complexity_p85")
        | gt("time_step_activity", "q_time_step_activity_p85")
    )
    seg = (
        F.when(high, F.lit(C.SEGMENT_HIGH_VALUE))
        .when(active, F.lit(C.SEGMENT_ACTIVE))
        .otherwise(F.lit(C.SEGMENT_LOW))
    )
    tags = gt("total_degree", "q_total_degree_p85").cast("int") + gt("neighbor_complexity", "q_neighbor_complexity_p85").cast("int")
    return metrics_df.withColumn("primary_segment", seg).withColumn("secondary_tag_count", tags)
