"""Per-segment percentile thresholds (long and wide) and their join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.operators.quantiles import quantile_long, quantile_wide


def threshold_long(segmented: DataFrame) -> DataFrame:
    """A4: primary_segment, metric, p75, p90, p95."""
    long = quantile_long(segmented, C.THRESHOLD_METRICS, C.THRESHOLD_PROBS, ["primary_segment"])
    return long.groupBy("primary_segment", "metric").agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(C.prob_label(p))
        for p in C.THRESHOLD_PROBS
    ])


def threshold_wide(segmented: DataFrame) -> DataFrame:
    """A5: one row per segment, ``thresh_<metric>_pNN`` columns."""
    return quantile_wide(segmented, C.THRESHOLD_METRICS, C.THRESHOLD_PROBS, ["primary_segment"], prefix="thresh_")


def percentile_table(df: DataFrame, metrics: Sequence[str],
                     probs: Sequence[float] = (0.10, 0.25, 0.75, 0.90, 0.95),
                     by_segment: bool = True) -> DataFrame:
    """Segment (or "_global"), metric, one column per probability."""
    groups = ["primary_segment"] if by_segment and "primary_segment" in df.columns else []
    long = quantile_long(df, metrics, probs, groups)
    if not groups:
        long = long.withColumn("primary_segment", F.lit("_global"))
    return long.groupBy("primary_segment", "metric").agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(C.prob_label(p))
        for p in probs
    ])


def join_thresholds(segmented: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows left join the wide thresholds of their segment.

    The wide table has one row per segment (three by construction): it is
    evaluated once and the join becomes a CASE on the segment per threshold
    column (a lookup inside the projection; a segment without thresholds gets
    NULL, as a left join would).
    """
    rows = [r.asDict() for r in wide.collect()]
    cols = [c for c in wide.columns if c != "primary_segment"]
    seg = F.col("primary_segment")
    out = []
    for c in cols:
        expr = None
        for r in rows:
            if r["primary_segment"] is None or r[c] is None:
                continue
            cond = seg == F.lit(r["primary_segment"])
            val = F.lit(float(r[c]))
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        out.append((expr if expr is not None else F.lit(None).cast("double")).alias(c))
    return segmented.select("*", *out)
