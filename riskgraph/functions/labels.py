"""Column expressions for labels, bands and case attributes (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgraph import config as C


def decode_class(class_raw: Column) -> Column:
    """Class text "1" -> illicit, "2" -> licit, anything else -> unknown."""
    return (
        F.when(class_raw == "1", F.lit("illicit"))
        .when(class_raw == "2", F.lit("licit"))
        .otherwise(F.lit("unknown"))
    )


def risk_level(score: Column) -> Column:
    """Band by the first threshold the score reaches (>=), highest first."""
    expr = None
    for threshold, label in C.RISK_BANDS:
        cond = score >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("Low"))


def public_band(level: Column) -> Column:
    """Critical/High -> high, Medium -> medium, anything else -> low."""
    return (
        F.when(level.isin("Critical", "High"), F.lit("high"))
        .when(level == "Medium", F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def severity(score: Column) -> Column:
    return (
        F.when(score >= 25, F.lit("high"))
        .when(score >= 15, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def flow_pattern(in_deg: Column, out_deg: Column) -> Column:
    return (
        F.when(out_deg >= F.greatest(F.lit(3), in_deg * 2), F.lit("fan-out"))
        .when(in_deg >= F.greatest(F.lit(3), out_deg * 2), F.lit("fan-in"))
        .otherwise(F.lit("balanced"))
    )


def flow_sentence(pattern: Column) -> Column:
    return (
        F.when(pattern == "fan-out", F.lit(C.CASE_STRUCTURE["fan-out"]))
        .when(pattern == "fan-in", F.lit(C.CASE_STRUCTURE["fan-in"]))
        .otherwise(F.lit(C.CASE_STRUCTURE["balanced"]))
    )


def display_label(label_name: Column) -> Column:
    return (
        F.when(label_name == "illicit", F.lit("illicit_for_evaluation_only"))
        .when(label_name == "licit", F.lit("licit_for_evaluation_only"))
        .otherwise(F.lit("unknown"))
    )


def model_score(score: Column) -> Column:
    return F.round(score.cast("double") / 100.0, 2)


def activity_stage(total_degree: Column) -> Column:
    return F.when(total_degree > 5, F.lit("Active spike")).otherwise(F.lit("Normal"))


def neighbor_signal(two_hop_share: Column) -> Column:
    return F.when(two_hop_share > 0, F.lit("elevated")).otherwise(F.lit("normal"))


def distance_label(one_hop_risky: Column, two_hop_risky: Column) -> Column:
    """Distance from risky-neighbour counts (not from rounded shares)."""
    return (
        F.when(one_hop_risky > 0, F.lit(C.DISTANCE_1))
        .when(two_hop_risky > 0, F.lit(C.DISTANCE_2))
        .otherwise(F.lit(C.DISTANCE_NONE))
    )
