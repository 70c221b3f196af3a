"""Case records for review screens, and the data steps of the review page
(draft lookup, effective values, rule panel, evidence parsing).

Windows here (percentile rank, case number) run only over the sample, whose
size is the batch parameter; ``population_pct_ranks`` ranks any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.functions import labels as L
from riskgraph.functions.rounding import round_share
from riskgraph.functions.text import mask_id, rule_id_dashed, rule_id_plain
from riskgraph.operators.quantiles import sorted_counts
from riskgraph.session import literal_rows, materialize

PCT_COLS = ["total_degree", "out_degree", "time_step_activity", "anonymized_behavior_intensity",
            "two_hop_risk_neighbor_share"]


def pct_rank_avg(col: str) -> Column:
    """Percentile rank with average ties, (min rank + (ties - 1) / 2) / n, over the whole frame."""
    c = F.col(col)
    n = F.count(c).over(Window.partitionBy(F.lit(1)))
    r = F.rank().over(Window.orderBy(c))
    ties = F.count(F.lit(1)).over(Window.partitionBy(c))
    return F.when(c.isNotNull(), (r + (ties - 1) / 2.0) / n)


def with_pct_ranks(sample: DataFrame, cols=PCT_COLS) -> DataFrame:
    out = sample
    for c in cols:
        out = out.withColumn(f"pct_{c}", pct_rank_avg(c))
    return out


def population_pct_ranks(df: DataFrame, cols) -> DataFrame:
    """W1 over any number of rows: adds ``pct_<col>``.

    Ranks come from the counts of distinct values (range-partitioned and sorted, as for the percentiles) and are joined
    back by value, so no task holds the population and a hot value is one counted row.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "metric", "value").where("value IS NOT NULL")
    values, sizes = sorted_counts(long, ["metric"], "value")
    ranks = materialize(values.join(sizes, "metric").select(
        "metric", "value", ((F.col("start") + 1 + (F.col("c") - 1) / 2.0) / F.col("n")).alias("pct")), "pct_ranks")
    out = df
    for c in cols:
        own = ranks.where(F.col("metric") == c).select(F.col("value").alias("_value"), F.col("pct").alias(f"pct_{c}"))
        out = out.join(own, F.col(c).cast("double") == F.col("_value"), "left").drop("_value")
    return out


def case_number(order_col: str = "draw") -> Column:
    """``ELL-001`` ... (no truncation past 999)."""
    return F.format_string("ELL-%03d", F.col(order_col))


def rule_breakdown(prefix_rules=C.SUPPORTED_RULE_IDS) -> Column:
    """A10 nested: array of (ruleId, name, severity, scoreContribution, keyEvidence, explanation)."""
    items = []
    for rid in prefix_rules:
        score = F.col(f"{rid}_score").cast("int")
        name = C.CASE_RULE_NAMES[rid]
        items.append(F.when(F.col(f"{rid}_hit"), F.struct(
            F.lit(rid.replace("R", "R-")).alias("ruleId"),
            F.lit(name).alias("name"),
            L.severity(score).alias("severity"),
            score.alias("scoreContribution"),
            F.array(*[F.lit(k) for k in C.CASE_EVIDENCE_KEYS[rid]]).alias("keyEvidence"),
            F.format_string(f"{name} contributed %d points.", score).alias("explanation"),
        )))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def hit_count() -> Column:
    total = F.lit(0)
    for rid in C.SUPPORTED_RULE_IDS:
        total = total + F.col(f"{rid}_hit").cast("int")
    return total


def graph_summary() -> Column:
    return C.sentence(C.CASE_GRAPH_SUMMARY, F.col("total_degree"), F.coalesce(F.col("one_hop_neighbor_count"), F.col("total_degree")))


def review_summary() -> Column:
    return C.sentence(C.CASE_REVIEW_SUMMARY, hit_count(), F.col("risk_score"))


def case_flat(queue: DataFrame) -> DataFrame:
    """C9 flat: one row per sampled case with every scalar field of the record."""
    s = with_pct_ranks(queue)
    pattern = L.flow_pattern(F.col("in_degree"), F.col("out_degree"))
    return s.select(
        case_number().alias("case_id"),
        F.col("id").alias("txId"),
        F.lit(C.CASE_SOURCE).alias("source"),
        F.lit(C.CASE_TYPE).alias("caseType"),
        F.col("time_step").alias("timeStep"),
        mask_id(F.col("id")).alias("transactionIdMasked"),
        L.display_label(F.col("label_name")).alias("demoLabel"),
        L.public_band(F.col("risk_level")).alias("riskBand"),
        L.model_score(F.col("risk_score")).alias("modelScore"),
        F.col("in_degree").alias("inputCount"),
        F.col("out_degree").alias("outputCount"),
        F.when(F.col("pct_out_degree") >= 0.8, F.lit("high")).otherwise(F.lit("medium")).alias("transactionVolumeBucket"),
        pattern.alias("flowPattern"),
        L.flow_sentence(pattern).alias("structureSummary"),
        F.col("one_hop_neighbor_count").alias("oneHopNeighborCount"),
        round_share(F.col("one_hop_risk_neighbor_share")).alias("oneHopRiskNeighborShare"),
        F.col("two_hop_neighbor_count").alias("twoHopNeighborCount"),
        round_share(F.col("two_hop_risk_neighbor_share")).alias("twoHopRiskNeighborShare"),
        F.col("distance_to_known_illicit_cluster").alias("distanceToKnownIllicitCluster"),
        L.neighbor_signal(F.col("two_hop_risk_neighbor_share")).alias("neighborAggregationSignal"),
        graph_summary().alias("graphSummary"),
        L.activity_stage(F.col("total_degree")).alias("activityStage"),
        review_summary().alias("reviewSummary"),
        F.col("risk_score").alias("riskScore"),
    )


def case_records(queue: DataFrame) -> DataFrame:
    """C9 nested: the full case record per sampled case."""
    flat = case_flat(queue)
    hits = queue.select("id", *[f"{r}_hit" for r in C.SUPPORTED_RULE_IDS], *[f"{r}_score" for r in C.SUPPORTED_RULE_IDS])
    df = flat.join(hits, flat.txId == hits.id).drop("id")
    rules = rule_breakdown()
    null_d = F.lit(None).cast("double")
    return df.select(
        F.col("case_id").alias("id"), "txId", "source", "caseType", "timeStep", "transactionIdMasked", "demoLabel",
        "riskBand", "modelScore",
        F.struct(
            F.lit(C.CASE_SCORE_TYPE).alias("scoreType"), F.col("modelScore").alias("modelScore"),
            F.col("riskBand").alias("riskBand"), F.lit(C.CASE_SCORE_MEANING).alias("scoreMeaning"),
            rules.alias("scoreBreakdown"),
        ).alias("modelSignals"),
        F.struct(
            "inputCount", "outputCount", null_d.alias("btcIn"), null_d.alias("btcOut"), null_d.alias("feeBtc"),
            null_d.alias("avgInputValueBtc"), null_d.alias("avgOutputValueBtc"), "transactionVolumeBucket",
            "flowPattern", "structureSummary",
        ).alias("transactionProfile"),
        F.struct(
            F.col("inputCount").alias("inDegree"), F.col("outputCount").alias("outDegree"), "oneHopNeighborCount",
            "oneHopRiskNeighborShare", "twoHopNeighborCount", "twoHopRiskNeighborShare",
            "distanceToKnownIllicitCluster", "neighborAggregationSignal", "graphSummary",
        ).alias("graphContext"),
        F.struct(
            "timeStep", F.lit(C.CASE_TOTAL_TIME_STEPS).alias("totalTimeSteps"),
            F.lit(C.CASE_WINDOW).alias("approximateWindow"), "activityStage",
            null_d.alias("peerPercentileTxCount"), null_d.alias("peerPercentileValueOut"),
        ).alias("temporalBehavior"),
        F.transform(rules, lambda r: r.dropFields("explanation")).alias("triggeredRules"),
        F.array().cast("array<struct<field:string,value:string,interpretation:string>>").alias("evidenceFields"),
        F.array().cast("array<struct<sourceId:string,title:string,publisher:string,page:bigint,chunkId:string,excerpt:string>>").alias("retrievedGuidance"),
        F.struct(
            F.col("reviewSummary").alias("summary"),
            F.transform(rules, lambda r: r["name"]).alias("keySignals"),
            F.array(*[F.lit(q) for q in C.CASE_QUESTIONS]).alias("reviewQuestions"),
            F.lit(C.CASE_BOUNDARY).alias("boundary"),
        ).alias("reviewDraft"),
        F.array(*[F.lit(c) for c in C.CASE_CONSTRAINTS]).alias("constraints"),
    )


def hits_long(scored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, rule_id, score) for every hit supported rule."""
    arr = F.filter(F.array(*[
        F.when(F.col(f"{r}_hit"), F.struct(F.lit(r).alias("rule_id"), F.col(f"{r}_score").cast("int").alias("score")))
        for r in C.SUPPORTED_RULE_IDS]), lambda x: x.isNotNull())
    return scored.select("id", *carry, F.inline(arr))


def score_breakdown_rows(scored: DataFrame) -> DataFrame:
    """A10 long: (id, rule_id, ruleId, name, scoreContribution, severity, explanation)."""
    h = hits_long(scored)
    name = F.element_at(F.create_map(*[x for r in C.SUPPORTED_RULE_IDS for x in (F.lit(r), F.lit(C.CASE_RULE_NAMES[r]))]),
                        F.col("rule_id"))
    return h.select(
        "id", "rule_id", rule_id_dashed(F.col("rule_id")).alias("ruleId"), name.alias("name"),
        F.col("score").alias("scoreContribution"), L.severity(F.col("score")).alias("severity"),
        F.format_string("%s contributed %d points.", name, F.col("score")).alias("explanation"),
    )


def rule_doc_table(spark: SparkSession) -> DataFrame:
    rows = [(r, *C.RULE_DOCS[r]) for r in C.RULE_IDS]
    return literal_rows(spark, rows, "rule_id string, rule_name string, pdr_rule_name string, description string, dataset_limit string")


def rule_panel(queue: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Every catalog rule for every case: active, severity, rank.

    A generator over the fixed five-entry catalog (no join); active if the case
    hit the rule or its draft names it."""
    catalog = F.array(*[F.struct(F.lit(i).alias("catalog_rule_id"), F.lit(n).alias("catalog_name")) for i, n in C.RULE_CATALOG])
    df = queue
    if drafts is not None:
        names = drafts.select("id", F.transform("triggered_reason_codes", lambda r: r["rule_name"]).alias("draft_rule_names"))
        df = df.join(names, "id", "left")
    else:
        df = df.withColumn("draft_rule_names", F.array().cast("array<string>"))
    x = df.select("id", *[f"{r}_hit" for r in C.SUPPORTED_RULE_IDS], *[f"{r}_score" for r in C.SUPPORTED_RULE_IDS],
                  "draft_rule_names", F.inline(catalog))
    hit = F.lit(False)
    sev = F.lit(None).cast("string")
    for r in C.SUPPORTED_RULE_IDS:
        is_r = F.col("catalog_rule_id") == r
        hit = hit | (is_r & F.col(f"{r}_hit"))
        sev = F.when(is_r & F.col(f"{r}_hit"), L.severity(F.col(f"{r}_score"))).otherwise(sev)
    severity = F.coalesce(sev, F.lit("medium"))
    active = hit | F.coalesce(F.array_contains(F.col("draft_rule_names"), F.col("catalog_name")), F.lit(False))
    rank_map = F.create_map(*[x for k, v in C.SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    rank = F.when(active, F.coalesce(F.element_at(rank_map, severity), F.lit(2))).otherwise(F.lit(0))
    return x.select("id", F.col("catalog_rule_id").alias("rule_id"), active.alias("active"),
                    severity.alias("severity"), rank.alias("severity_rank"))


def case_drafts(cases: DataFrame, drafts: DataFrame) -> DataFrame:
    """Each case with its draft flag (joined on the full id), and the pool
    of cases to draw from: those with a draft, or all cases if none has one."""
    d = drafts.select(F.col("txId").alias("_tx"), F.lit(True).alias("has_draft"))
    joined = cases.join(d, cases.txId == d._tx, "left").drop("_tx").withColumn(
        "has_draft", F.coalesce(F.col("has_draft"), F.lit(False)))
    any_draft = joined.agg(F.coalesce(F.max(F.col("has_draft").cast("int")), F.lit(0))).scalar()
    return joined.withColumn("in_pool", F.col("has_draft") | (any_draft == 0))


def case_effective(cases: DataFrame, drafts: DataFrame) -> DataFrame:
    """Draft value if present, else the case value."""
    d = drafts.select(F.col("txId").alias("_tx"), F.col("risk_level").alias("d_level"),
                      F.col("risk_score").alias("d_score"), F.col("risk_summary").alias("d_summary"),
                      F.col("analyst_decision").alias("d_status"), F.col("human_review_questions").alias("d_questions"))
    j = cases.join(d, cases.txId == d._tx, "left")
    questions = F.slice(F.coalesce(F.col("d_questions"), F.array(*[F.lit(q) for q in C.CASE_QUESTIONS])), 1, 4)
    return j.select(
        "case_id", "txId",
        F.coalesce(F.col("d_level"), F.col("riskBand")).alias("effective_level"),
        F.coalesce(F.col("d_score"), F.round(F.col("modelScore") * 100).cast("int")).alias("effective_score"),
        F.coalesce(F.col("d_summary"), F.col("reviewSummary")).alias("effective_summary"),
        F.coalesce(F.col("d_status"), F.lit(C.PENDING)).alias("effective_status"),
        F.array_join(questions, " | ").alias("effective_questions"),
    )


def parse_evidence(df: DataFrame, text_col: str = "evidence") -> DataFrame:
    """Split "k: v, k: v" on commas, then on the first colon; keys and values trimmed."""
    parts = F.posexplode(F.split(F.col(text_col), ","))
    x = df.select("id", "rule_id", parts.alias("pos", "part"))
    piece = F.trim(F.col("part"))
    key = F.trim(F.split(piece, ":", 2)[0])
    value = F.trim(F.coalesce(F.split(piece, ":", 2)[1], F.lit("")))
    return x.select("id", "rule_id", (F.col("pos") + 1).alias("pos"), key.alias("key"), value.alias("value"))


def glossary_table(spark: SparkSession) -> DataFrame:
    rows = [(k, label, C.EVIDENCE_EXPLAIN[k]) for k, label in C.EVIDENCE_GLOSSARY.items()]
    return literal_rows(spark, rows, "key string, label string, explain string")


def evidence_glossary(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    """Parsed entries with their glossary label (default: key with _ as spaces) and explanation."""
    g = F.broadcast(glossary_table(spark))  # fixed, configured glossary
    return parsed.join(g, "key", "left").select(
        "id", "rule_id", "pos", "key", "value",
        F.coalesce(F.col("label"), F.regexp_replace(F.col("key"), "_", " ")).alias("label"),
        F.coalesce(F.col("explain"), F.lit(C.EVIDENCE_DEFAULT_EXPLAIN)).alias("explain"),
    )

