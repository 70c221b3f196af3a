"""Rules as data: predicates (SQL text) evaluated against peer thresholds,
segment weights, capped score and band."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import config as C
from riskgraph.functions.labels import risk_level
from riskgraph.session import literal_rows


def rule_table(spark: SparkSession) -> DataFrame:
    """Rule dimension: rule_id, rule_name, pdr_rule_name, description, dataset_limit, predicate."""
    schema = T.StructType([
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("rule_name", T.StringType(), False),
        T.StructField("pdr_rule_name", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("dataset_limit", T.StringType(), False),
        T.StructField("predicate", T.StringType(), False),
    ])
    rows = [(rid, *C.RULE_DOCS[rid], C.RULE_PREDICATES[rid]) for rid in C.RULE_IDS]
    return literal_rows(spark, rows, schema.simpleString())


def weight_table(spark: SparkSession, mode: str = "published") -> DataFrame:
    schema = T.StructType([
        T.StructField("primary_segment", T.StringType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("weight", T.IntegerType(), False),
    ])
    return literal_rows(spark, C.weight_rows(mode), schema.simpleString())


def rule_hit(predicate_sql: str) -> Column:
    """A rule fires only when its predicate is true (NULL counts as not fired)."""
    return F.coalesce(F.expr(predicate_sql), F.lit(False))


def evaluate_rules(df: DataFrame, predicates: Mapping[str, str] | None = None) -> DataFrame:
    """One ``<rule>_hit`` boolean per rule, all in one projection."""
    preds = dict(predicates or C.RULE_PREDICATES)
    return df.select("*", *[rule_hit(sql).alias(f"{rid}_hit") for rid, sql in preds.items()])


def evaluate_rule_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluate every rule of a rule table (rule_id, predicate SQL text).

    The rule table is configuration-sized (one row per rule); its rows become
    one projection with a boolean column per rule.
    """
    preds = {r["rule_id"]: r["predicate"] for r in rules.select("rule_id", "predicate").collect()}
    return evaluate_rules(df, dict(sorted(preds.items())))


def weight_expr(segment: Column, rule_id: str, mode: str = "published") -> Column:
    """Weight of a rule for the row's segment; a segment not in the table gives 0."""
    expr = None
    for seg, rid, w in C.weight_rows(mode):
        if rid != rule_id:
            continue
        cond = segment == F.lit(seg)
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return F.lit(0) if expr is None else expr.otherwise(F.lit(0))


def apply_weights(df: DataFrame, mode: str = "published", rule_ids=C.RULE_IDS) -> DataFrame:
    """``<rule>_score`` = weight if hit else 0 (int)."""
    seg = F.col("primary_segment")
    return df.select("*", *[
        F.when(F.col(f"{rid}_hit"), weight_expr(seg, rid, mode)).otherwise(F.lit(0)).cast("int").alias(f"{rid}_score")
        for rid in rule_ids
    ])


def score_and_level(df: DataFrame, rule_ids=C.RULE_IDS) -> DataFrame:
    """Raw sum, score capped at 100, level band."""
    raw = None
    for rid in rule_ids:
        c = F.col(f"{rid}_score")
        raw = c if raw is None else raw + c
    return (
        df.withColumn("risk_score_raw", raw.cast("int"))
        .withColumn("risk_score", F.least(F.col("risk_score_raw"), F.lit(100)).cast("int"))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )


def triggered_rules(prefix_rules=C.SUPPORTED_RULE_IDS) -> Column:
    """Array of hit rule ids in rule order."""
    return F.filter(
        F.array(*[F.when(F.col(f"{rid}_hit"), F.lit(rid)) for rid in prefix_rules]),
        lambda x: x.isNotNull(),
    )


def weights_by_join(spark: SparkSession, hits_long: DataFrame, mode: str = "published") -> DataFrame:
    """J8 as a dimension join: hits (id, primary_segment, rule_id) x (segment, rule) weights; miss -> 0."""
    w = weight_table(spark, mode)
    return (
        hits_long.join(F.broadcast(w), ["primary_segment", "rule_id"], "left")  # configured segments x rules
        .select("id", "rule_id", F.coalesce(F.col("weight"), F.lit(0)).alias("weight"))
    )


def score_rule_table(df: DataFrame, rules: DataFrame, weights: DataFrame, segment: str = "primary_segment") -> DataFrame:
    """P12, J8, P13, P14 for a caller's rules: ids, predicates and weights come from tables alone.

    ``rules`` (rule_id, predicate SQL text) is configuration-sized: its rows become one projection.  ``weights``
    (segment, rule_id, weight) becomes one row per segment, a map from rule to weight (repeated rows add up), joined
    on the segment.  A rule without a weight, and a segment without any, scores 0.  Adds ``rule_hits`` (array of rule_id
    and score of the hit rules, in order of their ids), ``risk_score_raw``, ``risk_score`` and ``risk_level``.
    """
    preds = sorted((r["rule_id"], r["predicate"]) for r in rules.select("rule_id", "predicate").collect())
    if len({rid for rid, _ in preds}) < len(preds):
        raise ValueError("a rule id occurs twice in the rule table")
    hit = F.array(*[F.when(rule_hit(sql), F.lit(rid)) for rid, sql in preds]) if preds else F.array().cast("array<string>")
    per_rule = weights.where("rule_id IS NOT NULL AND weight IS NOT NULL").groupBy(F.col(segment).alias("_segment"), "rule_id").agg(
        F.sum("weight").cast("int").alias("weight"))
    per_segment = per_rule.groupBy("_segment").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "weight"))).alias("_weights"))
    out = df.withColumn("_hits", F.array_compact(hit)).join(per_segment, F.col(segment) == F.col("_segment"), "left")
    scores = F.transform("_hits", lambda r: F.struct(
        r.alias("rule_id"), F.coalesce(F.element_at("_weights", r), F.lit(0)).alias("score")))
    out = out.withColumn("rule_hits", scores).drop("_hits", "_segment", "_weights")
    out = out.withColumn("risk_score_raw", F.aggregate("rule_hits", F.lit(0), lambda total, r: total + r["score"]))
    return out.withColumn("risk_score", F.least("risk_score_raw", F.lit(100))).withColumn("risk_level", risk_level(F.col("risk_score")))
