"""Registered queries: one Spark plan and (where SQL can express it) one
DuckDB statement per key.  Every query reads the driver's tables and runs
over all of their rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.functions.rounding import python_round_ratio, ratio_sql, round_share_sql
from riskgraph.operators import graph as G
from riskgraph.operators import metrics as M
from riskgraph.operators import profile as PR
from riskgraph.operators import rules as R
from riskgraph.operators import sampling as S
from riskgraph.operators import thresholds as T
from riskgraph.plans import duck_sql as D
from riskgraph.plans import pipeline as P
from riskgraph.plans.pipeline import ScoreOptions, scored_nodes, segmented_nodes
from riskgraph.session import materialize, parts_for
from riskgraph.sources.tables import GraphInputs, load_graph

QueryFn = Callable[[SparkSession, str], DataFrame]

SKIP = D.SKIP
BATCH = D.BATCH
SEED = D.SEED

_memo: dict = {}


def _key(spark: SparkSession, sf: str, *extra) -> tuple:
    # the application id changes when a session is stopped and a new one started
    return (spark.sparkContext.applicationId, id(spark), sf.rstrip("/"), *extra)


def graph(spark: SparkSession, sf: str) -> GraphInputs:
    k = _key(spark, sf, "graph")
    if k not in _memo:
        _memo[k] = load_graph(spark, sf)
    return _memo[k]


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = _key(spark, sf, "metrics")
    if k not in _memo:
        g = graph(spark, sf)
        _memo[k] = M.node_metrics(g.nodes, g.edges, g.labels)
    return _memo[k]


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    k = _key(spark, sf, "segmented")
    if k not in _memo:
        _memo[k] = segmented_nodes(graph(spark, sf))
    return _memo[k]


def scored(spark: SparkSession, sf: str, mode: str = "published") -> DataFrame:
    k = _key(spark, sf, "scored", mode)
    if k not in _memo:
        _memo[k] = scored_nodes(graph(spark, sf), ScoreOptions(weights=mode))
    return _memo[k]


def sample(spark: SparkSession, sf: str) -> DataFrame:
    """The review sample: skip SKIP, pool 5 x BATCH, md5 draw of BATCH, with draw order."""
    k = _key(spark, sf, "sample")
    if k not in _memo:
        cases = S.sample_cases(scored(spark, sf), SKIP, BATCH, SEED)
        from pyspark.sql import Window

        w = Window.orderBy(S.draw_key(SEED), F.col("id"))  # <= BATCH rows
        _memo[k] = cases.withColumn("draw", F.row_number().over(w))
    return _memo[k]


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled scored rows with their exposure (computed for the sample only)."""
    k = _key(spark, sf, "queue")
    if k not in _memo:
        _memo[k] = P.review_queue(scored(spark, sf), graph(spark, sf), P.RunOptions(skip_top=SKIP, batch_size=BATCH, seed=SEED))
    return _memo[k]


def mixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified batches of two seeds, with draw order: every risk level, segment and rule occurs in it."""
    k = _key(spark, sf, "mixed")
    if k not in _memo:
        from pyspark.sql import Window

        cases = S.sample_merged(scored(spark, sf), ["risk_level"], [SEED, SEED + 1], C.PER_STRATUM).drop("rn", "batch")
        w = Window.orderBy(S.draw_key(SEED), F.col("id"))  # <= 2 x strata x PER_STRATUM rows
        _memo[k] = cases.withColumn("draw", F.row_number().over(w))
    return _memo[k]


def mixed_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of the review keys: the mixed sample with features and exposure."""
    k = _key(spark, sf, "mixed_queue")
    if k not in _memo:
        _memo[k] = P.queue_of(mixed_sample(spark, sf), graph(spark, sf))
    return _memo[k]


def mixed_sql(select: str) -> str:
    return D.with_sql(select, sample=D.MIXED)


REG: dict[str, tuple[QueryFn, str | None]] = {}


def register(key: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REG[key] = (fn, sql)
        return fn
    return deco


METRIC_COLS = ["id", "time_step", "label_name", "in_degree", "out_degree", "total_degree", "neighbor_complexity",
               "time_step_activity", "out_in_ratio", "anonymized_behavior_intensity"]
HIT_COLS = [f"{r}_hit" for r in C.RULE_IDS]
SCORE_COLS = [f"{r}_score" for r in C.RULE_IDS]
SCORED_COLS = METRIC_COLS + ["primary_segment", "secondary_tag_count"] + HIT_COLS + SCORE_COLS + [
    "risk_score_raw", "risk_score", "risk_level"]
EXPOSURE_COLS = ["one_hop_neighbor_count", "one_hop_risky_count", "one_hop_risk_neighbor_share",
                 "two_hop_neighbor_count", "two_hop_risky_count", "two_hop_risk_neighbor_share",
                 "distance_to_known_illicit_cluster"]


def cols(names: list[str], alias: str | None = None) -> str:
    return ", ".join(f"{alias}.{n}" if alias else n for n in names)


# --------------------------------------------------------------------------- aggregations / joins / metrics

@register("agg_degree", D.with_sql("SELECT id, out_degree, in_degree FROM deg"))
def q_agg_degree(spark, sf):
    return M.degree_counts(graph(spark, sf).edges)


@register("agg_time_step", D.with_sql("SELECT time_step, time_step_activity AS node_count FROM steps"))
def q_agg_time_step(spark, sf):
    return M.time_step_counts(graph(spark, sf).nodes).withColumnRenamed("time_step_activity", "node_count")


@register("join_labels", D.with_sql("SELECT n.id, coalesce(l.label_name, 'unknown') AS label_name FROM g_nodes n LEFT JOIN g_labels l ON l.id = n.id"))
def q_join_labels(spark, sf):
    g = graph(spark, sf)
    return M.with_labels(g.nodes.select("id"), g.labels)


@register("join_degrees", D.with_sql("SELECT id, out_degree, in_degree FROM metrics"))
def q_join_degrees(spark, sf):
    return metrics(spark, sf).select("id", "out_degree", "in_degree")


@register("metric_activity", D.with_sql("SELECT id, time_step, time_step_activity FROM metrics"))
def q_metric_activity(spark, sf):
    return metrics(spark, sf).select("id", "time_step", "time_step_activity")


@register("win_activity", D.with_sql("SELECT id, time_step, CAST(count(*) OVER (PARTITION BY time_step) AS BIGINT) AS time_step_activity FROM g_nodes"))
def q_win_activity(spark, sf):
    # W2 as a grouped count joined back: same values as a window count, without
    # holding a whole time step in one task.
    nodes = graph(spark, sf).nodes.select("id", "time_step")
    return nodes.join(M.time_step_counts(nodes), "time_step", "left").select("id", "time_step", "time_step_activity")


@register("metric_degree", D.with_sql("SELECT id, in_degree, out_degree, total_degree, neighbor_complexity FROM metrics"))
def q_metric_degree(spark, sf):
    return metrics(spark, sf).select("id", "in_degree", "out_degree", "total_degree", "neighbor_complexity")


@register("metric_ratio", D.with_sql("SELECT id, out_in_ratio FROM metrics"))
def q_metric_ratio(spark, sf):
    return metrics(spark, sf).select("id", "out_in_ratio")


@register("metric_intensity", D.with_sql("SELECT id, anonymized_behavior_intensity FROM metrics"))
def q_metric_intensity(spark, sf):
    return metrics(spark, sf).select("id", "anonymized_behavior_intensity")


@register("node_metrics", D.with_sql(f"SELECT {cols(METRIC_COLS)} FROM metrics"))
def q_node_metrics(spark, sf):
    return metrics(spark, sf).select(*METRIC_COLS)


_GQ = [f"q_{m}_{C.prob_label(p)}" for m in C.SEGMENT_METRICS for p in C.SEGMENT_PROBS]


@register("agg_global_quantiles", D.with_sql(f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _GQ)} FROM gq"))
def q_agg_global_quantiles(spark, sf):
    q = PR.global_quantiles(metrics(spark, sf))
    return q.select(*[F.round(c, 6).alias(c) for c in _GQ])


@register("segment_assign", D.with_sql("SELECT id, primary_segment FROM segmented"))
def q_segment_assign(spark, sf):
    return segmented(spark, sf).select("id", "primary_segment")


@register("segment_tags", D.with_sql("SELECT id, secondary_tag_count FROM segmented"))
def q_segment_tags(spark, sf):
    return segmented(spark, sf).select("id", "secondary_tag_count")


_PL = [C.prob_label(p) for p in C.THRESHOLD_PROBS]
_TW = [f"thresh_{m}_{lab}" for m in C.THRESHOLD_METRICS for lab in _PL]
_UNPIVOT_TW = " UNION ALL ".join(
    f"SELECT primary_segment, '{m}' AS metric, "
    + ", ".join(f"round(thresh_{m}_{lab}, 6) AS {lab}" for lab in _PL) + " FROM tw"
    for m in C.THRESHOLD_METRICS)


@register("threshold_long", D.with_sql(_UNPIVOT_TW))
def q_threshold_long(spark, sf):
    t = T.threshold_long(segmented(spark, sf))
    return t.select("primary_segment", "metric", *[F.round(c, 6).alias(c) for c in _PL])


@register("threshold_wide", D.with_sql(f"SELECT primary_segment, {', '.join(f'round({c}, 6) AS {c}' for c in _TW)} FROM tw"))
def q_threshold_wide(spark, sf):
    t = T.threshold_wide(segmented(spark, sf))
    return t.select("primary_segment", *[F.round(c, 6).alias(c) for c in _TW])


_A6_PROBS = (0.10, 0.25, 0.75, 0.90, 0.95)
_A6_LABS = [C.prob_label(p) for p in _A6_PROBS]
_A6_SQL = " UNION ALL ".join(
    f"SELECT primary_segment, '{m}' AS metric, "
    + ", ".join(f"round(quantile_cont({m}::DOUBLE, {p}), 6) AS {C.prob_label(p)}" for p in _A6_PROBS)
    + " FROM segmented GROUP BY primary_segment"
    for m in C.THRESHOLD_METRICS)


@register("agg_percentiles", D.with_sql(_A6_SQL))
def q_agg_percentiles(spark, sf):
    t = T.percentile_table(segmented(spark, sf), C.THRESHOLD_METRICS, _A6_PROBS)
    return t.select("primary_segment", "metric", *[F.round(c, 6).alias(c) for c in _A6_LABS])


_A6_GLOBAL_SQL = " UNION ALL ".join(
    f"SELECT '_global' AS primary_segment, '{m}' AS metric, "
    + ", ".join(f"round(quantile_cont({m}::DOUBLE, {p}), 6) AS {C.prob_label(p)}" for p in _A6_PROBS) + " FROM segmented"
    for m in C.THRESHOLD_METRICS)


@register("agg_percentiles_global", D.with_sql(_A6_GLOBAL_SQL))
def q_agg_percentiles_global(spark, sf):
    t = T.percentile_table(segmented(spark, sf), C.THRESHOLD_METRICS, _A6_PROBS, by_segment=False)
    return t.select("primary_segment", "metric", *[F.round(c, 6).alias(c) for c in _A6_LABS])


@register("threshold_join", D.with_sql(f"SELECT id, primary_segment, {', '.join(f'round({c}, 6) AS {c}' for c in _TW)} FROM with_thresh"))
def q_threshold_join(spark, sf):
    seg = segmented(spark, sf)
    j = T.join_thresholds(seg, T.threshold_wide(seg))
    return j.select("id", "primary_segment", *[F.round(c, 6).alias(c) for c in _TW])


for _i, _rid in enumerate(C.RULE_IDS, start=1):
    def _mk(rid):
        def fn(spark, sf):
            return scored(spark, sf).select("id", f"{rid}_hit")
        return fn
    register(f"rule_r{_i:03d}", D.with_sql(f"SELECT id, {_rid}_hit FROM hits"))(_mk(_rid))


@register("rules_all", D.with_sql(f"SELECT id, {cols(HIT_COLS)} FROM hits"))
def q_rules_all(spark, sf):
    seg = segmented(spark, sf)
    df = R.evaluate_rule_table(T.join_thresholds(seg, T.threshold_wide(seg)), R.rule_table(spark))
    return df.select("id", *HIT_COLS)


@register("rule_scores", D.with_sql(f"SELECT id, primary_segment, {cols(SCORE_COLS)} FROM weighted"))
def q_rule_scores(spark, sf):
    return scored(spark, sf).select("id", "primary_segment", *SCORE_COLS)


@register("rule_scores_literal", D.with_sql(f"SELECT id, primary_segment, {cols(SCORE_COLS)} FROM weighted", mode="literal"))
def q_rule_scores_literal(spark, sf):
    return scored(spark, sf, "literal").select("id", "primary_segment", *SCORE_COLS)


@register("score_total", D.with_sql("SELECT id, risk_score_raw, risk_score FROM scored"))
def q_score_total(spark, sf):
    return scored(spark, sf).select("id", "risk_score_raw", "risk_score")


@register("score_level", D.with_sql("SELECT id, risk_score, risk_level FROM scored"))
def q_score_level(spark, sf):
    return scored(spark, sf).select("id", "risk_score", "risk_level")


@register("score_level_literal", D.with_sql("SELECT id, risk_score, risk_level FROM scored", mode="literal"))
def q_score_level_literal(spark, sf):
    return scored(spark, sf, "literal").select("id", "risk_score", "risk_level")


@register("scored_nodes", D.with_sql(f"SELECT {cols(SCORED_COLS)} FROM scored"))
def q_scored_nodes(spark, sf):
    return scored(spark, sf).select(*SCORED_COLS)


# A caller's own rules: seven predicates; weights for one segment only, and none for R-E.
OWN_RULES = [
    ("R-A", "total_degree > thresh_total_degree_p95"), ("R-B", "in_degree >= 3 * out_degree AND in_degree > 3"), ("R-C", "out_degree = 0"),
    ("R-D", "time_step % 7 = 0"), ("R-E", "label_name = 'illicit'"),
    ("R-F", "anonymized_behavior_intensity < thresh_anonymized_behavior_intensity_p75"),
    ("R-G", "neighbor_complexity > thresh_neighbor_complexity_p90 AND out_in_ratio > 1")]
OWN_WEIGHTS = [(C.SEGMENT_LOW, "R-A", 40), (C.SEGMENT_LOW, "R-B", 15), (C.SEGMENT_LOW, "R-C", 5), (C.SEGMENT_LOW, "R-D", 3), (C.SEGMENT_LOW, "R-F", 2),
               (C.SEGMENT_LOW, "R-G", 50), (C.SEGMENT_LOW, "R-G", 9)]  # repeated weights add up
_OWN_WEIGHT = {rid: sum(w for _, r, w in OWN_WEIGHTS if r == rid) for rid, _ in OWN_RULES}
_OWN_SQL = D.with_sql(
    "SELECT id, primary_segment, hits, risk_score_raw, CAST(least(risk_score_raw, 100) AS INTEGER) AS risk_score, CASE WHEN least(risk_score_raw, 100) >= 80 "
    "THEN 'Critical' WHEN risk_score_raw >= 60 THEN 'High' WHEN risk_score_raw >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level FROM ("
    "SELECT id, primary_segment, concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{r}' END" for r, p in OWN_RULES) + ") AS hits, "
    f"CAST(CASE WHEN primary_segment = {D.q(C.SEGMENT_LOW)} THEN " + " + ".join(
        f"CASE WHEN {p} THEN {_OWN_WEIGHT[r]} ELSE 0 END" for r, p in OWN_RULES) + " ELSE 0 END AS INTEGER) AS risk_score_raw FROM with_thresh) t")


@register("rules_own_table", _OWN_SQL)
def q_rules_own_table(spark, sf):
    """P12 to P14 with rules and weights that only the caller's tables name."""
    opts = ScoreOptions(rules=spark.createDataFrame(OWN_RULES, "rule_id string, predicate string"),
                        rule_weights=spark.createDataFrame(OWN_WEIGHTS, "primary_segment string, rule_id string, weight int"))
    df = scored_nodes(graph(spark, sf), opts)
    return df.select("id", "primary_segment", F.array_join(F.transform("rule_hits", lambda r: r["rule_id"]), ",").alias("hits"),
                     "risk_score_raw", "risk_score", "risk_level")


@register("agg_triggered", D.with_sql(
    "SELECT id, " + "concat_ws(',', " + ", ".join(f"CASE WHEN {r}_hit THEN '{r}' END" for r in C.SUPPORTED_RULE_IDS)
    + ") AS triggered_rules FROM scored"))
def q_agg_triggered(spark, sf):
    return scored(spark, sf).select("id", F.array_join(R.triggered_rules(), ",").alias("triggered_rules"))


# --------------------------------------------------------------------------- graph

@register("graph_adjacency", D.with_sql("SELECT a, b FROM adj"))
def q_graph_adjacency(spark, sf):
    return G.adjacency(graph(spark, sf).edges)


def _exposure_all(spark, sf):
    k = _key(spark, sf, "exposure_all")
    if k not in _memo:
        g = graph(spark, sf)
        # all nodes: pairs are enumerated around ordinary nodes, reach through hubs is a union of bitmaps
        _memo[k] = G.exposure(g.ids, G.adjacency(g.edges, parts_for(spark, 2 * g.edges.count())), G.risky_nodes(g.ids, g.labels),
                              hub_limit=G.hub_degree(g.ids.count()))
    return _memo[k]


@register("exposure_1hop", D.with_sql("SELECT id, one_hop_neighbor_count, one_hop_risky_count, one_hop_risk_neighbor_share FROM exposure"))
def q_exposure_1hop(spark, sf):
    g = graph(spark, sf)
    parts = parts_for(spark, 2 * g.edges.count())
    return G.one_hop_exposure(g.ids, G.adjacency(g.edges, parts), G.risky_nodes(g.ids, g.labels), parts)


@register("exposure_2hop", D.with_sql("SELECT id, two_hop_neighbor_count, two_hop_risky_count, two_hop_risk_neighbor_share FROM exposure"))
def q_exposure_2hop(spark, sf):
    return _exposure_all(spark, sf).select("id", "two_hop_neighbor_count", "two_hop_risky_count", "two_hop_risk_neighbor_share")


@register("exposure_hubs", D.with_sql("SELECT id, two_hop_neighbor_count, two_hop_risky_count FROM exposure"))
def q_exposure_hubs(spark, sf):
    """J6 with the reach through the nodes of more than 20 neighbours as unions of bitmaps (the driver's graph has no
    node above the degree from which an all-node run does so)."""
    g = graph(spark, sf)
    e = G.exposure(g.ids, G.adjacency(g.edges, parts_for(spark, 2 * g.edges.count())), G.risky_nodes(g.ids, g.labels), hub_limit=20)
    return e.select("id", "two_hop_neighbor_count", "two_hop_risky_count")


@register("exposure_full", D.with_sql(f"SELECT id, {cols(EXPOSURE_COLS)} FROM exposure"))
def q_exposure_full(spark, sf):
    return _exposure_all(spark, sf).select("id", *EXPOSURE_COLS)


@register("exposure_distance", D.with_sql("SELECT id, distance_to_known_illicit_cluster FROM exposure"))
def q_exposure_distance(spark, sf):
    return _exposure_all(spark, sf).select("id", "distance_to_known_illicit_cluster")


_CC_SQL = """WITH RECURSIVE
e AS (SELECT src, dst FROM (
        SELECT l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey) AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t WHERE dst IS NOT NULL),
und AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) t WHERE a <> b),
ids AS (SELECT o_orderkey AS id FROM orders UNION SELECT a FROM und),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id FROM ids
  UNION
  SELECT u.b AS id, min(c.comp) AS comp
  FROM cc c JOIN und u ON u.a = c.id
  LEFT JOIN recurring.cc r ON r.id = u.b
  GROUP BY u.b, r.comp
  HAVING min(c.comp) < r.comp
)
SELECT id, comp AS component FROM cc WHERE id IN (SELECT o_orderkey FROM orders)"""


@register("graph_components", _CC_SQL)
def q_graph_components(spark, sf):
    g = graph(spark, sf)
    comp, _rounds = G.connected_components(g.ids, g.edges)
    return comp.join(g.ids, "id", "left_semi")


@register("graph_component_summary", _CC_SQL.replace(
    "SELECT id, comp AS component FROM cc WHERE id IN (SELECT o_orderkey FROM orders)",
    "SELECT CAST(count(*) AS BIGINT) AS component_count, max(size) AS largest_component_size, "
    "CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singleton_count FROM ("
    "SELECT comp, count(*) AS size FROM cc WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY comp) s"))
def q_graph_component_summary(spark, sf):
    g = graph(spark, sf)
    comp, _rounds = G.connected_components(g.ids, g.edges)
    return G.component_summary(comp, g.ids)


# --------------------------------------------------------------------------- ranking and sampling

@register("rank_nodes", D.with_sql("SELECT id, risk_score, rank FROM ranked"))
def q_rank_nodes(spark, sf):
    return S.global_rank(scored(spark, sf).select("id", "risk_score"), S.rank_order()).select("id", "risk_score", "rank")


@register("sample_pool", D.with_sql("SELECT id, risk_score, risk_level FROM pool"))
def q_sample_pool(spark, sf):
    return S.sample_pool(scored(spark, sf), SKIP, BATCH).select("id", "risk_score", "risk_level")


@register("sample_pool_histogram", D.with_sql("SELECT id, risk_score, risk_level FROM pool"))
def q_sample_pool_histogram(spark, sf):
    # the same pool from the score column alone: distributed selection needs nothing else
    return S.sample_pool(scored(spark, sf).select("id", "risk_score", "risk_level"), SKIP, BATCH)


@register("sample_cases", D.with_sql("SELECT id, risk_score, risk_level, draw FROM sample"))
def q_sample_cases(spark, sf):
    return sample(spark, sf).select("id", "risk_score", "risk_level", "draw")


@register("agg_risk_levels", mixed_sql("SELECT risk_level, CAST(count(*) AS BIGINT) AS case_count FROM sample GROUP BY risk_level"))
def q_agg_risk_levels(spark, sf):
    return mixed_sample(spark, sf).groupBy("risk_level").agg(F.count(F.lit(1)).alias("case_count"))


_STRAT_SQL = D.with_sql(
    "SELECT id, risk_level, rn FROM (SELECT id, risk_level, row_number() OVER (PARTITION BY risk_level "
    "ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM scored) t WHERE rn <= 25")


@register("sample_stratified", _STRAT_SQL)
def q_sample_stratified(spark, sf):
    return S.sample_stratified(scored(spark, sf), ["risk_level"], C.PER_STRATUM, SEED).select(
        "id", "risk_level", F.col("rn").cast("bigint").alias("rn"))


_MERGED_BODY = (
    "SELECT id, risk_level, batch FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch) AS k FROM ("
    "SELECT id, risk_level, 0 AS batch FROM (SELECT id, risk_level, row_number() OVER (PARTITION BY risk_level "
    "ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM scored) a WHERE rn <= 25 UNION ALL "
    "SELECT id, risk_level, 1 AS batch FROM (SELECT id, risk_level, row_number() OVER (PARTITION BY risk_level "
    "ORDER BY md5('43:' || CAST(id AS VARCHAR)), id) AS rn FROM scored) b WHERE rn <= 25) u) v WHERE k = 1")
_MERGED_SQL = D.with_sql(_MERGED_BODY)


@register("sample_merged", _MERGED_SQL)
def q_sample_merged(spark, sf):
    m = S.sample_merged(scored(spark, sf), ["risk_level"], [SEED, SEED + 1], C.PER_STRATUM)
    return m.select("id", "risk_level", "batch")


@register("review_queue", D.with_sql(
    f"SELECT {cols(SCORED_COLS)}, f_001, f_002, f_003, {cols(EXPOSURE_COLS)}, draw FROM queue"))
def q_review_queue(spark, sf):
    return review_queue(spark, sf).select(*SCORED_COLS, "f_001", "f_002", "f_003", *EXPOSURE_COLS, "draw")


# --------------------------------------------------------------------------- corpus and retrieval

from riskgraph.operators import corpus as CO  # noqa: E402
from riskgraph.sources.tables import load_corpus_pages  # noqa: E402


def chunks(spark, sf):
    k = _key(spark, sf, "chunks")
    if k not in _memo:
        _memo[k] = CO.corpus_chunks(spark, load_corpus_pages(spark, sf))
    return _memo[k]


@register("src_corpus", D.corpus_sql("SELECT source_id, title, publisher, url, page, text FROM pages"))
def q_src_corpus(spark, sf):
    return CO.corpus_pages(spark, load_corpus_pages(spark, sf)).select("source_id", "title", "publisher", "url", "page", "text")


@register("text_normalise", D.corpus_sql("SELECT source_id, page, text FROM pages"))
def q_text_normalise(spark, sf):
    from riskgraph.functions.text import normalise_ws

    pages = load_corpus_pages(spark, sf)
    return pages.select("source_id", "page", normalise_ws(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


@register("corpus_chunks", D.corpus_sql("SELECT source_id, page, chunk_no, chunk_id, text FROM chunks"))
def q_corpus_chunks(spark, sf):
    return chunks(spark, sf).select("source_id", "page", "chunk_no", "chunk_id", "text")


_KW_SQL = D.corpus_sql(" UNION ALL ".join(
    f"SELECT chunk_id, {D.q(kw)} AS keyword, kw{i} AS kw_count FROM kwc WHERE kw{i} > 0"
    for i, kw in enumerate(D.vocab_names())))


@register("text_keyword_counts", _KW_SQL)
def q_text_keyword_counts(spark, sf):
    vocab = CO.keyword_vocabulary(C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS)
    kc = CO.keyword_counts(chunks(spark, sf), vocab)
    pairs = F.arrays_zip(F.array(*[F.lit(v) for v in vocab]).alias("keyword"), F.col("kw_counts").alias("kw_count"))
    return kc.select("chunk_id", F.inline(pairs)).where(F.col("kw_count") > 0)


def list_scores(spark, sf):
    k = _key(spark, sf, "list_scores")
    if k not in _memo:
        vocab = CO.keyword_vocabulary(C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS)
        posted = CO.postings(chunks(spark, sf), vocab)
        _memo[k] = materialize(CO.list_scores(posted, C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS), "list_scores")
    return _memo[k]


@register("rag_postings", _KW_SQL)
def q_rag_postings(spark, sf):
    """The postings table, the text scanned once for all keywords."""
    vocab = CO.keyword_vocabulary(C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS)
    return CO.postings(chunks(spark, sf), vocab).select("chunk_id", "keyword", F.col("n").alias("kw_count"))


@register("rag_scores", D.corpus_sql("SELECT rule_mask, chunk_id, retrieval_score FROM mask_scores"))
def q_rag_scores(spark, sf):
    return CO.set_scores(list_scores(spark, sf)).select("rule_mask", "chunk_id", "retrieval_score")


@register("rag_topk", D.corpus_sql(
    f"SELECT rule_mask, chunk_rank, chunk_id, retrieval_score, substring(text, 1, {C.EXCERPT_CHARS}) AS excerpt FROM topk"))
def q_rag_topk(spark, sf):
    top, _ = CO.topk_by_threshold(list_scores(spark, sf))
    top = CO.with_excerpts(top, chunks(spark, sf))
    return top.select("rule_mask", F.col("chunk_rank").cast("bigint").alias("chunk_rank"), "chunk_id",
                      "retrieval_score", "excerpt")


# --------------------------------------------------------------------------- review layer

from riskgraph.operators import cases as CA  # noqa: E402
from riskgraph.operators import review as RV  # noqa: E402
from riskgraph.operators import summary as SU  # noqa: E402
from riskgraph.functions import labels as L  # noqa: E402
from riskgraph.functions import text as X  # noqa: E402

_HL = "hl AS (" + " UNION ALL ".join(
    f"SELECT id, '{r}' AS rule_id, {r}_score AS score FROM scored WHERE {r}_hit" for r in C.SUPPORTED_RULE_IDS) + ")"
_QHL = "qhl AS (" + " UNION ALL ".join(
    f"SELECT id, '{r}' AS rule_id, {r}_score AS score FROM queue WHERE {r}_hit" for r in C.SUPPORTED_RULE_IDS) + ")"
_DOCS = "docs(rule_id, rule_name, pdr_rule_name, description, dataset_limit) AS (VALUES " + ", ".join(
    "(" + ", ".join(D.q(x) for x in (r, *C.RULE_DOCS[r])) + ")" for r in C.RULE_IDS) + ")"
_NAMES = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {D.q(C.CASE_RULE_NAMES[r])}" for r in C.SUPPORTED_RULE_IDS) + " END"
_SEV = "CASE WHEN score >= 25 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END"
_BAND = "CASE WHEN risk_level IN ('Critical', 'High') THEN 'high' WHEN risk_level = 'Medium' THEN 'medium' ELSE 'low' END"
_FLOW = ("CASE WHEN out_degree >= greatest(3, in_degree * 2) THEN 'fan-out' "
         "WHEN in_degree >= greatest(3, out_degree * 2) THEN 'fan-in' ELSE 'balanced' END")
_DEMO = ("CASE WHEN label_name = 'illicit' THEN 'illicit_for_evaluation_only' "
         "WHEN label_name = 'licit' THEN 'licit_for_evaluation_only' ELSE 'unknown' END")
_MASK = "left(CAST(id AS VARCHAR), 2) || '...' || right(CAST(id AS VARCHAR), 2)"


def _wsql(extra: list[str], select: str) -> str:
    return "WITH " + ",\n".join(D.ctes(sample=D.MIXED) + extra) + "\n" + select


def _pct_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
            f" / count({c}) OVER () END")


def _ev_text_sql(kind: str, c: str) -> str:
    if kind == "int":
        return f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
    if kind == "double":
        return f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)"
    return f"CAST({c} AS VARCHAR)"


_EVROWS = "evrows AS (" + " UNION ALL ".join(
    f"SELECT id, '{r}' AS rule_id, {pos} AS field_pos, '{f}' AS field, "
    + ("CAST(NULL AS DOUBLE)" if k == "text" else f"CAST({f} AS DOUBLE)") + " AS num_value, "
    + _ev_text_sql(k, f) + f" AS text_value FROM queue WHERE {r}_hit"
    for r in C.SUPPORTED_RULE_IDS for pos, (f, k) in enumerate(C.EVIDENCE_FIELDS[r], start=1)) + ")"
_EVTEXT = "evtext AS (" + " UNION ALL ".join(
    f"SELECT id, '{r}' AS rule_id, " + " || ', ' || ".join(f"'{f}: ' || {_ev_text_sql(k, f)}" for f, k in C.EVIDENCE_FIELDS[r])
    + f" AS evidence FROM queue WHERE {r}_hit" for r in C.SUPPORTED_RULE_IDS) + ")"
_EVPARSE = """evparse AS (
  SELECT id, rule_id, CAST(i AS INTEGER) AS pos,
         trim(split_part(trim(parts[i]), ':', 1)) AS key,
         trim(CASE WHEN strpos(trim(parts[i]), ':') > 0 THEN substring(trim(parts[i]), strpos(trim(parts[i]), ':') + 1) ELSE '' END) AS value
  FROM (SELECT id, rule_id, string_split(evidence, ',') AS parts FROM evtext) t, range(1, len(parts) + 1) r(i))"""


def queue_ev(spark, sf):
    q = mixed_queue(spark, sf)
    parts = [F.when(F.col(f"{r}_hit"), F.struct(F.lit(r).alias("rule_id"), RV.evidence_text_expr(r).alias("evidence")))
             for r in C.SUPPORTED_RULE_IDS]
    return q.select("id", F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def _contexts(spark, sf):
    k = _key(spark, sf, "contexts")
    if k not in _memo:
        q = mixed_queue(spark, sf)
        retrieved = CO.retrieve_for_cases(q, chunks(spark, sf), C.TOP_K_CHUNKS, C.DRIVER_RULE_KEYWORDS,
                                          C.DRIVER_DEFAULT_KEYWORDS, list_scores(spark, sf))
        _memo[k] = RV.review_contexts(q, retrieved)
    return _memo[k]


# Model answers by draw number: none, a full draft with a key of its own, cut-off JSON, reason codes that no case has
# (R006) or not all have (R001), a null field, a field of another type with the rest missing, JSON that is no object.
_FULL = ('"suspicious_behavior_description": ["b"], "evidence_references": [{"rule_id": "R001", "evidence": "e"}], '
         '"missing_information": ["m"], "suggested_next_review_action": "act"')
_R001_NAME = dict(C.RULE_CATALOG)["R001"]
_ANSWER = f"""CASE draw % 7
 WHEN 1 THEN '{{"risk_summary": "Case ' || CAST(id AS STRING) || '", "triggered_reason_codes": [], {_FULL}, "human_review_questions": ["q1", "q2"], "summary_zh": "x"}}'
 WHEN 2 THEN '{{"risk_summary": "cut off'
 WHEN 3 THEN '{{"risk_summary": "codes", "triggered_reason_codes": [{{"rule_id": "R006"}}, {{"rule_id": "R001", "rule_name": "{_R001_NAME}"}}], {_FULL}, "human_review_questions": ["q3"]}}'
 WHEN 4 THEN '{{"risk_summary": "null field", "triggered_reason_codes": [], {_FULL}, "human_review_questions": null}}'
 WHEN 5 THEN '{{"risk_summary": "s", "missing_information": "one item"}}'
 WHEN 6 THEN '[1, 2]' END"""
_RESP = ("resp AS (SELECT *, CASE WHEN json_valid(content) THEN content END AS js FROM "
         f"(SELECT id, draw % 7 AS m, {_ANSWER} AS content FROM queue WHERE draw % 7 <> 0) t)")
_OK = "coalesce(json_type(js) = 'OBJECT', false)"


def _responses(spark, sf):
    return mixed_queue(spark, sf).where("draw % 7 <> 0").select("id", F.expr(_ANSWER).alias("content"))


def _drafts(spark, sf):
    """A draft for every case: the model's where it answered with an object, else the template."""
    k = _key(spark, sf, "drafts")
    if k not in _memo:
        _memo[k] = materialize(RV.merge_drafts(_contexts(spark, sf), _responses(spark, sf)), "drafts")
    return _memo[k]


def _answered(spark, sf):
    """Drafts of the cases that were answered at all; the others are shown without a draft."""
    return _drafts(spark, sf).join(_responses(spark, sf).select("id"), "id", "left_semi")


@register("rule_docs_join", _wsql([_HL, _DOCS], "SELECT hl.id, hl.rule_id, rule_name, pdr_rule_name, description, dataset_limit FROM hl JOIN docs USING (rule_id)"))
def q_rule_docs_join(spark, sf):
    h = CA.hits_long(scored(spark, sf))
    return h.join(F.broadcast(CA.rule_doc_table(spark)), "rule_id").select(  # 6 configured rules
        "id", "rule_id", "rule_name", "pdr_rule_name", "description", "dataset_limit")


_WTS = "wts(primary_segment, rule_id, weight) AS (VALUES " + ", ".join(
    f"({D.q(seg)}, '{r}', {w})" for seg, r, w in C.weight_rows("published")) + ")"


@register("rule_weights_join", _wsql([_HL, _WTS],
          "SELECT hl.id, hl.rule_id, coalesce(w.weight, 0) AS weight FROM hl JOIN scored s ON s.id = hl.id "
          "LEFT JOIN wts w ON w.primary_segment = s.primary_segment AND w.rule_id = hl.rule_id"))
def q_rule_weights_join(spark, sf):
    """J8 as a dimension join: hits x (segment, rule) weights, a miss gives 0."""
    return R.weights_by_join(spark, CA.hits_long(scored(spark, sf), carry=("primary_segment",)))


@register("score_breakdown", _wsql([_HL], f"SELECT id, rule_id, replace(rule_id, 'R', 'R-') AS ruleId, {_NAMES} AS name, score AS scoreContribution, {_SEV} AS severity, {_NAMES} || ' contributed ' || CAST(score AS VARCHAR) || ' points.' AS explanation FROM hl"))
def q_score_breakdown(spark, sf):
    return CA.score_breakdown_rows(scored(spark, sf))


@register("case_severity", _wsql([_HL], f"SELECT id, rule_id, score, {_SEV} AS severity FROM hl"))
def q_case_severity(spark, sf):
    h = CA.hits_long(scored(spark, sf))
    return h.select("id", "rule_id", "score", L.severity(F.col("score")).alias("severity"))


@register("case_band", mixed_sql(f"SELECT id, risk_level, {_BAND} AS riskBand FROM scored"))
def q_case_band(spark, sf):
    return scored(spark, sf).select("id", "risk_level", L.public_band(F.col("risk_level")).alias("riskBand"))


@register("case_flow", mixed_sql(
    f"SELECT id, in_degree, out_degree, {_FLOW} AS flowPattern, CASE {_FLOW} "
    + " ".join(f"WHEN '{k}' THEN {D.q(v)}" for k, v in C.CASE_STRUCTURE.items()) + " END AS structureSummary FROM metrics"))
def q_case_flow(spark, sf):
    m = metrics(spark, sf)
    pattern = L.flow_pattern(F.col("in_degree"), F.col("out_degree"))
    return m.select("id", "in_degree", "out_degree", pattern.alias("flowPattern"), L.flow_sentence(pattern).alias("structureSummary"))


@register("case_label", mixed_sql(f"SELECT id, label_name, {_DEMO} AS demoLabel FROM metrics"))
def q_case_label(spark, sf):
    return metrics(spark, sf).select("id", "label_name", L.display_label(F.col("label_name")).alias("demoLabel"))


@register("case_model_score", mixed_sql("SELECT id, risk_score, round(risk_score / 100.0, 2) AS modelScore FROM scored"))
def q_case_model_score(spark, sf):
    return scored(spark, sf).select("id", "risk_score", L.model_score(F.col("risk_score")).alias("modelScore"))


@register("case_activity", mixed_sql("SELECT id, total_degree, CASE WHEN total_degree > 5 THEN 'Active spike' ELSE 'Normal' END AS activityStage FROM metrics"))
def q_case_activity(spark, sf):
    return metrics(spark, sf).select("id", "total_degree", L.activity_stage(F.col("total_degree")).alias("activityStage"))


@register("case_neighbor_signal", mixed_sql("SELECT id, two_hop_risk_neighbor_share, CASE WHEN two_hop_risk_neighbor_share > 0 THEN 'elevated' ELSE 'normal' END AS neighborAggregationSignal FROM queue"))
def q_case_neighbor_signal(spark, sf):
    q = mixed_queue(spark, sf)
    return q.select("id", "two_hop_risk_neighbor_share", L.neighbor_signal(F.col("two_hop_risk_neighbor_share")).alias("neighborAggregationSignal"))


@register("win_pct_rank", mixed_sql("SELECT id, " + ", ".join(f"{_pct_sql(c)} AS pct_{c}" for c in CA.PCT_COLS) + " FROM queue"))
def q_win_pct_rank(spark, sf):
    return CA.with_pct_ranks(mixed_queue(spark, sf)).select("id", *[f"pct_{c}" for c in CA.PCT_COLS])


@register("win_pct_rank_all", D.with_sql("SELECT id, " + ", ".join(f"{_pct_sql(c)} AS pct_{c}" for c in CA.PCT_COLS[:4]) + " FROM metrics"))
def q_win_pct_rank_all(spark, sf):
    """W1 over every node."""
    return CA.population_pct_ranks(metrics(spark, sf), CA.PCT_COLS[:4]).select("id", *[f"pct_{c}" for c in CA.PCT_COLS[:4]])


_LINE_D = {"share": "CAST(l_quantity AS BIGINT)", "share_of_five": "5 * CAST(l_quantity AS BIGINT)"}


@register("round_python", "SELECT l_orderkey, l_linenumber, l_quantity, " + ", ".join(
    f"{ratio_sql('CAST(l_linenumber AS BIGINT)', d, 4)} AS {name}" for name, d in _LINE_D.items()) + " FROM lineitem WHERE l_quantity >= 1")
def q_round_python(spark, sf):
    """Quotients rounded as Python rounds them; 1/32 and 1/160 are among them."""
    lines = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet").where("l_quantity >= 1")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", *[
        python_round_ratio(F.col("l_linenumber"), F.expr(d), 4).alias(name) for name, d in _LINE_D.items()])


@register("case_volume", mixed_sql(f"SELECT id, out_degree, CASE WHEN {_pct_sql('out_degree')} >= 0.8 THEN 'high' ELSE 'medium' END AS transactionVolumeBucket FROM queue"))
def q_case_volume(spark, sf):
    return CA.case_flat(mixed_queue(spark, sf)).select(F.col("txId").alias("id"), F.col("outputCount").alias("out_degree"), "transactionVolumeBucket")


@register("case_number", mixed_sql("SELECT id, printf('ELL-%03d', draw) AS case_id FROM queue"))
def q_case_number(spark, sf):
    return mixed_queue(spark, sf).select("id", CA.case_number().alias("case_id"))


@register("text_mask", mixed_sql(f"SELECT id, {_MASK} AS transactionIdMasked FROM g_nodes"))
def q_text_mask(spark, sf):
    return graph(spark, sf).nodes.select("id", X.mask_id(F.col("id")).alias("transactionIdMasked"))


@register("text_rule_id", _wsql([_HL], "SELECT id, rule_id, replace(rule_id, 'R', 'R-') AS ruleId, regexp_replace(replace(rule_id, 'R', 'R-'), '-', '') AS rule_id_back FROM hl"))
def q_text_rule_id(spark, sf):
    h = CA.hits_long(scored(spark, sf))
    dashed = X.rule_id_dashed(F.col("rule_id"))
    return h.select("id", "rule_id", dashed.alias("ruleId"), X.rule_id_plain(dashed).alias("rule_id_back"))


_GRAPH_SENTENCE = C.sentence_sql(C.CASE_GRAPH_SUMMARY, "total_degree", "one_hop_neighbor_count")
_REVIEW_SENTENCE = C.sentence_sql(C.CASE_REVIEW_SUMMARY, " + ".join(f"CAST({r}_hit AS INTEGER)" for r in C.SUPPORTED_RULE_IDS), "risk_score")
_DEF_COLS = ("id, label_name, primary_segment, risk_score, risk_level, one_hop_neighbor_count, one_hop_risk_neighbor_share, "
             "two_hop_neighbor_count, two_hop_risk_neighbor_share, distance_to_known_illicit_cluster")


@register("case_defaults", mixed_sql(f"SELECT {_DEF_COLS} FROM queue"))
def q_case_defaults(spark, sf):
    ctx = _contexts(spark, sf)
    return ctx.select(
        "id", F.col("known_label_for_research_only").alias("label_name"),
        F.col("address_profile_adapter.primary_segment").alias("primary_segment"),
        F.col("risk.risk_score").alias("risk_score"), F.col("risk.risk_level").alias("risk_level"),
        "graph_exposure.one_hop_neighbor_count", "graph_exposure.one_hop_risk_neighbor_share",
        "graph_exposure.two_hop_neighbor_count", "graph_exposure.two_hop_risk_neighbor_share",
        "graph_exposure.distance_to_known_illicit_cluster")


@register("case_text", mixed_sql(
    f"SELECT id, {_GRAPH_SENTENCE} AS graphSummary, {_REVIEW_SENTENCE} AS reviewSummary FROM queue"))
def q_case_text(spark, sf):
    return mixed_queue(spark, sf).select("id", CA.graph_summary().alias("graphSummary"), CA.review_summary().alias("reviewSummary"))


_FLAT_SQL = mixed_sql(
    "SELECT printf('ELL-%03d', draw) AS case_id, id AS txId, " + D.q(C.CASE_SOURCE) + " AS source, " + D.q(C.CASE_TYPE)
    + f" AS caseType, time_step AS timeStep, {_MASK} AS transactionIdMasked, {_DEMO} AS demoLabel, {_BAND} AS riskBand,"
    " round(risk_score / 100.0, 2) AS modelScore, in_degree AS inputCount, out_degree AS outputCount,"
    f" CASE WHEN {_pct_sql('out_degree')} >= 0.8 THEN 'high' ELSE 'medium' END AS transactionVolumeBucket,"
    f" {_FLOW} AS flowPattern, CASE {_FLOW} " + " ".join(f"WHEN '{k}' THEN {D.q(v)}" for k, v in C.CASE_STRUCTURE.items())
    + " END AS structureSummary, one_hop_neighbor_count AS oneHopNeighborCount,"
    f" {round_share_sql('one_hop_risk_neighbor_share')} AS oneHopRiskNeighborShare, two_hop_neighbor_count AS twoHopNeighborCount,"
    f" {round_share_sql('two_hop_risk_neighbor_share')} AS twoHopRiskNeighborShare,"
    " distance_to_known_illicit_cluster AS distanceToKnownIllicitCluster,"
    " CASE WHEN two_hop_risk_neighbor_share > 0 THEN 'elevated' ELSE 'normal' END AS neighborAggregationSignal,"
    f" {_GRAPH_SENTENCE} AS graphSummary,"
    " CASE WHEN total_degree > 5 THEN 'Active spike' ELSE 'Normal' END AS activityStage,"
    f" {_REVIEW_SENTENCE} AS reviewSummary,"
    " risk_score AS riskScore FROM queue")


@register("case_flat", _FLAT_SQL)
def q_case_flat(spark, sf):
    return CA.case_flat(mixed_queue(spark, sf))


@register("evidence_rows", _wsql([_EVROWS], "SELECT id, rule_id, field_pos, field, num_value, text_value FROM evrows"))
def q_evidence_rows(spark, sf):
    return RV.evidence_rows(mixed_queue(spark, sf))


@register("evidence_text", _wsql([_EVTEXT], "SELECT id, rule_id, evidence FROM evtext"))
def q_evidence_text(spark, sf):
    return queue_ev(spark, sf)


def _clean_sql(c: str) -> str:
    out = c
    for old, new in C.REVIEW_TEXT_REPLACEMENTS:
        out = f"replace({out}, {D.q(old)}, {D.q(new)})"
    return out


@register("text_clean", _wsql([_EVTEXT], f"SELECT id, rule_id, {_clean_sql('evidence')} AS cleaned FROM evtext"))
def q_text_clean(spark, sf):
    return queue_ev(spark, sf).select("id", "rule_id", X.clean_review_text(F.col("evidence")).alias("cleaned"))


@register("evidence_parse", _wsql([_EVTEXT, _EVPARSE], "SELECT id, rule_id, pos, key, value FROM evparse"))
def q_evidence_parse(spark, sf):
    return CA.parse_evidence(queue_ev(spark, sf))


_GLOSS = "gloss(key, label, explain) AS (VALUES " + ", ".join(
    f"({D.q(k)}, {D.q(v)}, {D.q(C.EVIDENCE_EXPLAIN[k])})" for k, v in C.EVIDENCE_GLOSSARY.items()) + ")"


@register("evidence_glossary", _wsql([_EVTEXT, _EVPARSE, _GLOSS],
          "SELECT id, rule_id, pos, key, value, coalesce(label, replace(key, '_', ' ')) AS label, "
          f"coalesce(explain, {D.q(C.EVIDENCE_DEFAULT_EXPLAIN)}) AS explain FROM evparse LEFT JOIN gloss USING (key)"))
def q_evidence_glossary(spark, sf):
    return CA.evidence_glossary(spark, CA.parse_evidence(queue_ev(spark, sf)))


_PANEL_SQL = _wsql([], "SELECT id, rule_id, active, severity, CASE WHEN active THEN CASE severity "
                   + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SEVERITY_RANK.items())
                   + " ELSE 2 END ELSE 0 END AS severity_rank FROM (" + " UNION ALL ".join(
                       f"SELECT id, '{r}' AS rule_id, {r}_hit OR (draw % 7 = 3 AND '{r}' = 'R001') AS active, CASE WHEN {r}_hit THEN "
                       f"CASE WHEN {r}_score >= 25 THEN 'high' WHEN {r}_score >= 15 THEN 'medium' ELSE 'low' END "
                       "ELSE 'medium' END AS severity FROM queue" for r, _n in C.RULE_CATALOG) + ") t")


@register("rule_panel", _PANEL_SQL)
def q_rule_panel(spark, sf):
    return CA.rule_panel(mixed_queue(spark, sf), _answered(spark, sf))


_VIOLATIONS = " UNION ALL ".join(
    ["SELECT id, 'reason_code_not_triggered' AS violation, 'R006' AS detail FROM resp WHERE m = 3",
     "SELECT r.id, 'reason_code_not_triggered' AS violation, 'R001' AS detail FROM resp r JOIN queue q USING (id) WHERE m = 3 AND NOT R001_hit",
     "SELECT id, 'missing_field' AS violation, 'human_review_questions' AS detail FROM resp WHERE m = 4"]
    + [f"SELECT id, 'missing_field' AS violation, '{c}' AS detail FROM resp WHERE m = 5" for c in RV.DRAFT_BODY if c != "risk_summary"])


@register("draft_violations", _wsql([_RESP], _VIOLATIONS))
def q_draft_violations(spark, sf):
    return RV.draft_violations(_drafts(spark, sf), mixed_queue(spark, sf))


@register("case_drafts", mixed_sql("SELECT printf('ELL-%03d', draw) AS case_id, id AS txId, draw % 7 <> 0 AS has_draft, draw % 7 <> 0 AS in_pool FROM queue"))
def q_case_drafts(spark, sf):
    flat = CA.case_flat(mixed_queue(spark, sf))
    return CA.case_drafts(flat, _answered(spark, sf)).select("case_id", "txId", "has_draft", "in_pool")


_TEMPLATE = C.sentence_sql(C.FALLBACK_SUMMARY, "id")


@register("case_effective", _wsql([_RESP, f"""eff AS (
  SELECT q.*, printf('ELL-%03d', draw) AS case_id, r.m, {_OK} AS ok, r.js FROM queue q LEFT JOIN resp r USING (id))"""],
    f"SELECT case_id, id AS txId, CASE WHEN m IS NULL THEN {_BAND} ELSE risk_level END AS effective_level, risk_score AS effective_score, "
    f"CASE WHEN m IS NULL THEN {_REVIEW_SENTENCE} WHEN ok THEN json_extract_string(js, '$.risk_summary') "
    f"ELSE {_TEMPLATE} END AS effective_summary, " + D.q(C.PENDING) + " AS effective_status, "
    f"CASE WHEN m IN (1) THEN 'q1 | q2' WHEN m = 3 THEN 'q3' WHEN m IN (2, 6) THEN {D.q(' | '.join(C.FALLBACK_QUESTIONS[:4]))} "
    f"ELSE {D.q(' | '.join(C.CASE_QUESTIONS[:4]))} END AS effective_questions FROM eff"))
def q_case_effective(spark, sf):
    flat = CA.case_flat(mixed_queue(spark, sf))
    return CA.case_effective(flat, _answered(spark, sf))


@register("sample_one", mixed_sql(
    "SELECT printf('ELL-%03d', draw) AS case_id, id AS txId FROM queue WHERE draw % 7 <> 0 "
    "ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 1"))
def q_sample_one(spark, sf):
    """One case drawn (seeded) from the cases that have a draft (all cases if none has)."""
    flat = CA.case_flat(mixed_queue(spark, sf))
    pool = CA.case_drafts(flat, _answered(spark, sf)).where("in_pool")
    return S.seeded_sample(pool, 1, SEED, id_col="txId").select("case_id", "txId")


_MASK_SQL = " + ".join(f"CAST({r}_hit AS INTEGER) * {1 << i}" for i, r in enumerate(C.SUPPORTED_RULE_IDS))
_CTX_FLAT_SQL = ("WITH " + ",\n".join(D.ctes(sample=D.MIXED) + D.corpus_ctes()) + "\n"
    "SELECT q.id, q.id AS txId, q.label_name AS known_label, q.primary_segment, q.risk_score, q.risk_level, "
    "q.one_hop_neighbor_count, q.one_hop_risk_neighbor_share, q.two_hop_neighbor_count, q.two_hop_risk_neighbor_share, "
    "q.distance_to_known_illicit_cluster, "
    "concat_ws(',', " + ", ".join(f"CASE WHEN q.{r}_hit THEN '{r}' END" for r in C.SUPPORTED_RULE_IDS) + ") AS triggered, "
    "coalesce((SELECT string_agg(t.chunk_id, ',' ORDER BY t.chunk_rank) FROM topk t WHERE t.rule_mask = (" + _MASK_SQL.replace("R0", "q.R0") + ")), '') AS chunk_ids, "
    f"{len(C.UNAVAILABLE_FIELDS)} AS n_missing FROM queue q")


@register("review_contexts_flat", _CTX_FLAT_SQL)
def q_review_contexts_flat(spark, sf):
    c = _contexts(spark, sf)
    return c.select(
        "id", F.col("review_object.txId").alias("txId"), F.col("known_label_for_research_only").alias("known_label"),
        F.col("address_profile_adapter.primary_segment").alias("primary_segment"),
        F.col("risk.risk_score").alias("risk_score"), F.col("risk.risk_level").alias("risk_level"),
        "graph_exposure.one_hop_neighbor_count", "graph_exposure.one_hop_risk_neighbor_share",
        "graph_exposure.two_hop_neighbor_count", "graph_exposure.two_hop_risk_neighbor_share",
        "graph_exposure.distance_to_known_illicit_cluster",
        F.array_join(F.transform("triggered_rules", lambda r: r["rule_id"]), ",").alias("triggered"),
        F.array_join(F.transform("retrieved_pdf_chunks", lambda x: x["chunk_id"]), ",").alias("chunk_ids"),
        F.size("missing_information").alias("n_missing"),
    )


_NOTE_CASE = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {D.q(C.PROXY_NOTES[r])}" for r in C.SUPPORTED_RULE_IDS) + " END"
_DOC_NAME = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {D.q(C.RULE_DOCS[r][0])}" for r in C.SUPPORTED_RULE_IDS) + " END"
_DRAFT_FLAT_SQL = _wsql([_QHL, _EVTEXT], (
    "SELECT q.id, q.id AS txId, q.risk_score, q.risk_level, "
    f"{C.sentence_sql(C.FALLBACK_SUMMARY, 'q.id')} AS risk_summary, "
    f"coalesce((SELECT string_agg({C.sentence_sql(C.FALLBACK_REASON, _DOC_NAME, 'score')}, ' | ' ORDER BY rule_id) "
    "FROM qhl h WHERE h.id = q.id), '') AS descriptions, "
    f"coalesce((SELECT string_agg('[' || rule_id || '] ' || {_NOTE_CASE}, ' | ' ORDER BY rule_id) FROM qhl h WHERE h.id = q.id), '') AS behaviors, "
    "coalesce((SELECT string_agg(rule_id || '=' || evidence, ' | ' ORDER BY rule_id) FROM evtext e WHERE e.id = q.id), '') AS evidence, "
    f"{D.q(C.PENDING)} AS analyst_decision, 'fallback' AS llm_status FROM queue q"))


@register("draft_fallback_flat", _DRAFT_FLAT_SQL)
def q_draft_fallback_flat(spark, sf):
    d = RV.fallback_drafts(_contexts(spark, sf))
    return d.select(
        "id", "txId", "risk_score", "risk_level", "risk_summary",
        F.array_join(F.transform("triggered_reason_codes", lambda r: r["description"]), " | ").alias("descriptions"),
        F.array_join("suspicious_behavior_description", " | ").alias("behaviors"),
        F.array_join(F.transform("evidence_references", lambda e: F.concat(e["rule_id"], F.lit("="), e["evidence"])), " | ").alias("evidence"),
        "analyst_decision", "llm_status",
    )


@register("review_contexts", None)
def q_review_contexts(spark, sf):
    return _contexts(spark, sf)


@register("draft_fallback", None)
def q_draft_fallback(spark, sf):
    return RV.fallback_drafts(_contexts(spark, sf))


def _json_sql(field: str, kind: str) -> str:
    value = f"""'"' || {field} || '"'""" if kind == "text" else _ev_text_sql(kind, field)
    return f"""'"{field}": ' || {value}"""


_REQ_USER = (D.q(C.DRAFT_USER_PREFIX) + " || '{\"txId\": ' || CAST(id AS VARCHAR) || ', \"risk_level\": \"' || risk_level || '\", \"triggered_rules\": [' || "
    "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {r}_hit THEN " + D.q(f'{{"rule_id": "{r}", "rule_name": {json.dumps(C.RULE_DOCS[r][0])}, "evidence": {{') + " || "
        + " || ', ' || ".join(_json_sql(f, k) for f, k in C.EVIDENCE_FIELDS[r]) + " || "
        + D.q(f', "proxy_note": {json.dumps(C.PROXY_NOTES[r])}}}, "limit": {json.dumps(C.RULE_DOCS[r][3])}}}') + " END" for r in C.SUPPORTED_RULE_IDS)
    + ") || " + D.q(f'], "missing_info": {json.dumps(list(C.UNAVAILABLE_FIELDS))}}}'))


@register("draft_requests", mixed_sql(
    f"SELECT id, {D.q(C.DRAFT_PROMPT)} AS system, {_REQ_USER} AS \"user\", CAST(0.1 AS DOUBLE) AS temperature FROM queue"))
def q_draft_requests(spark, sf):
    return RV.draft_requests(_contexts(spark, sf))


@register("src_responses", _wsql([_RESP], f"SELECT id, {_OK} AS parsed_ok FROM resp"))
def q_src_responses(spark, sf):
    return RV.parse_responses(_responses(spark, sf)).select("id", "parsed_ok")


@register("src_responses_turns", f"SELECT conv_id, turn, {_OK} AS parsed_ok, json_extract_string(CASE WHEN {_OK} THEN js END, '$.risk_summary') "
          "AS risk_summary FROM (SELECT conv_id, turn, CASE WHEN json_valid(text) THEN text END AS js FROM conversations WHERE role = 'assistant') t")
def q_src_responses_turns(spark, sf):
    """S6 over every assistant turn, so that its work follows the table; the seven kinds of answers are in src_responses."""
    turns = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet").where("role = 'assistant'")
    parsed = RV.parse_responses(turns.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("content")))
    return parsed.select("id.conv_id", "id.turn", "parsed_ok", F.col("parsed.risk_summary").alias("risk_summary"))


@register("draft_merge", None)
def q_draft_merge(spark, sf):
    return _drafts(spark, sf)


def _joined(column):
    return F.coalesce(F.array_join(column, " | "), F.lit(""))


def _draft_flat(d):
    return d.select(
        "txId", "risk_score", "risk_level", "llm_status", "risk_summary", "analyst_decision",
        _joined(F.transform("triggered_reason_codes", lambda r: r["rule_id"])).alias("codes"),
        _joined(F.col("human_review_questions")).alias("questions"), F.size(F.coalesce("missing_information", F.array())).alias("n_missing"))


_LIST = lambda path: f"coalesce(array_to_string(json_extract_string(js, '{path}'), ' | '), '')"
_MERGE_SQL = _wsql([_RESP, _QHL, f"""mrg AS (
  SELECT q.*, {_OK} AS ok, r.js, r.m FROM queue q LEFT JOIN resp r USING (id))"""],
    "SELECT id AS txId, risk_score, risk_level, CASE WHEN ok THEN 'success' ELSE 'fallback' END AS llm_status, "
    f"CASE WHEN ok THEN json_extract_string(js, '$.risk_summary') ELSE {_TEMPLATE} END AS risk_summary, {D.q(C.PENDING)} AS analyst_decision, "
    f"CASE WHEN ok THEN {_LIST('$.triggered_reason_codes[*].rule_id')} ELSE coalesce((SELECT string_agg(rule_id, ' | ' ORDER BY rule_id) "
    "FROM qhl h WHERE h.id = mrg.id), '') END AS codes, "
    f"CASE WHEN ok THEN {_LIST('$.human_review_questions[*]')} ELSE {D.q(' | '.join(C.FALLBACK_QUESTIONS))} END AS questions, "
    f"CASE WHEN ok AND m = 5 THEN 0 WHEN ok THEN 1 ELSE {len(C.UNAVAILABLE_FIELDS)} END AS n_missing FROM mrg")


@register("draft_merge_flat", _MERGE_SQL)
def q_draft_merge_flat(spark, sf):
    return _draft_flat(_drafts(spark, sf))


_REQ_RULES = "concat_ws(',', " + ", ".join(f"CASE WHEN {r}_hit THEN '{r}' END" for r in C.SUPPORTED_RULE_IDS) + ")"


@register("draft_requests_flat", mixed_sql(
    f"SELECT id, id AS txId, risk_level, {_REQ_RULES} AS rules, CASE WHEN R003_hit THEN out_degree END AS r003_out_degree, "
    f"{len(C.UNAVAILABLE_FIELDS)} AS n_missing, CAST(0.1 AS DOUBLE) AS temperature FROM queue"))
def q_draft_requests_flat(spark, sf):
    """Draft requests, their JSON payload read back."""
    r = RV.draft_requests(_contexts(spark, sf))
    body = F.from_json(F.substring("user", len(C.DRAFT_USER_PREFIX) + 1, 1 << 30),
                       "txId long, risk_level string, triggered_rules array<struct<rule_id:string,evidence:map<string,string>>>, missing_info array<string>")
    r = r.select("id", body.alias("b"), "temperature")
    third = F.filter("b.triggered_rules", lambda x: x["rule_id"] == "R003")
    return r.select("id", "b.txId", "b.risk_level", F.array_join(F.transform("b.triggered_rules", lambda x: x["rule_id"]), ",").alias("rules"),
                    F.get(third, 0)["evidence"]["out_degree"].cast("long").alias("r003_out_degree"),
                    F.size("b.missing_info").alias("n_missing"), "temperature")


@register("case_records", None)
def q_case_records(spark, sf):
    return CA.case_records(mixed_queue(spark, sf))


# --------------------------------------------------------------------------- summary

@register("summary_profile", mixed_sql(
    "SELECT (SELECT count(*) FROM g_nodes) AS node_count, (SELECT count(*) FROM g_edges) AS directed_edge_count, "
    "(SELECT count(DISTINCT time_step) FROM g_nodes) AS time_step_count, (SELECT min(time_step) FROM g_nodes) AS time_step_min, "
    "(SELECT max(time_step) FROM g_nodes) AS time_step_max, 5 AS raw_feature_count, 3 AS anonymous_feature_count"))
def q_summary_profile(spark, sf):
    g = graph(spark, sf)
    return SU.dataset_profile(g.nodes, g.edges, g.steps)


@register("summary_labels", mixed_sql("SELECT label_name, count(*) AS node_count FROM metrics GROUP BY label_name"))
def q_summary_labels(spark, sf):
    g = graph(spark, sf)
    return SU.label_distribution(g.nodes, g.labels)


@register("summary_degree", mixed_sql(
    "SELECT e AS directed_edge_count, n AS node_count, round(2.0 * e / n, 4) AS average_directed_degree FROM "
    "(SELECT (SELECT count(*) FROM g_edges) AS e, (SELECT count(*) FROM g_nodes) AS n) t"))
def q_summary_degree(spark, sf):
    g = graph(spark, sf)
    return SU.average_degree(g.nodes, g.edges)


@register("summary_cases", "WITH " + ",\n".join(D.ctes() + [f"mrg AS ({_MERGED_BODY})"]) + "\n" + (
    f"SELECT dimension, value, count(*) AS case_count FROM (SELECT 'riskBand' AS dimension, {_BAND} AS value FROM mrg "
    f"UNION ALL SELECT 'demoLabel' AS dimension, {_DEMO} AS value FROM mrg JOIN metrics USING (id)) x GROUP BY dimension, value"))
def q_summary_cases(spark, sf):
    m = S.sample_merged(scored(spark, sf), ["risk_level"], [SEED, SEED + 1], C.PER_STRATUM)
    return SU.case_distributions(m)


# --------------------------------------------------------------------------- sources and sinks

from riskgraph import sinks as K  # noqa: E402
from riskgraph.session import scratch_path  # noqa: E402
from riskgraph.schema import DATASET_SUMMARY, DRAFT_RECORD  # noqa: E402
from riskgraph.sources import files as FS  # noqa: E402


def _raw_inputs(spark, sf) -> str:
    """The driver graph written as the three raw CSV inputs (labels, edges, headerless
    wide features) into the shared scratch folder; returns the folder."""
    k = _key(spark, sf, "raw_inputs")
    if k not in _memo:
        g = graph(spark, sf)
        root = scratch_path(spark, "raw_inputs")
        g.labels.select(F.col("id").alias("txId"), F.col("class_raw").alias("class")).write.option(
            "header", "true").csv(f"{root}/{FS.INPUT_NAMES['classes']}")
        g.edges.select(F.col("src").alias("txId1"), F.col("dst").alias("txId2")).write.option(
            "header", "true").csv(f"{root}/{FS.INPUT_NAMES['edges']}")
        g.nodes.select("id", F.col("time_step").cast("double"), "f_001", "f_002", "f_003").write.option(
            "header", "false").csv(f"{root}/{FS.INPUT_NAMES['features']}")
        _memo[k] = root
    return _memo[k]


def _found(spark, sf) -> dict:
    root = _raw_inputs(spark, sf)
    return {r["key"]: r["path"] for r in FS.discover(spark, root).collect()}  # at most 3 rows


@register("src_discover", D.with_sql(
    "SELECT 'classes' AS key, (SELECT count(*) FROM g_labels) AS n_rows UNION ALL SELECT 'edges' AS key, (SELECT count(*) FROM g_edges) AS n_rows "
    "UNION ALL SELECT 'features' AS key, (SELECT count(*) FROM g_nodes) AS n_rows"))
def q_src_discover(spark, sf):
    """The three raw inputs found by name, with the rows that each file holds."""
    found = _found(spark, sf)
    frames = {"classes": FS.read_labels(spark, found["classes"]), "edges": FS.read_edges(spark, found["edges"]),
              "features": FS.read_nodes(spark, found["features"], n_features=3)}
    out = None
    for key, frame in frames.items():
        row = frame.agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@register("src_labels", mixed_sql("SELECT id, class_raw, label_name FROM g_labels"))
def q_src_labels(spark, sf):
    return FS.read_labels(spark, _found(spark, sf)["classes"])


@register("src_edges", mixed_sql("SELECT src, dst FROM g_edges"))
def q_src_edges(spark, sf):
    return FS.read_edges(spark, _found(spark, sf)["edges"])


@register("src_nodes", mixed_sql("SELECT id, CAST(time_step AS DOUBLE) AS time_step, f_001, f_002, f_003 FROM g_nodes"))
def q_src_nodes(spark, sf):
    return FS.read_nodes(spark, _found(spark, sf)["features"], n_features=3)


def _written(spark, sf, name: str, df_fn) -> tuple[str, DataFrame, int]:
    """Path, frame and rows (counted while writing) of an output."""
    k = _key(spark, sf, "written", name)
    if k not in _memo:
        df = df_fn()
        path = scratch_path(spark, name)
        put = {"queue": K.put_csv, "contexts": K.put_contexts, "drafts": K.put_drafts}.get(name, K.put_json)
        _memo[k] = (path, df, put(df, path))
    return _memo[k]


def _cases_written(spark, sf):
    return _written(spark, sf, "cases", lambda: CA.case_records(mixed_queue(spark, sf)))


def _contexts_written(spark, sf):
    return _written(spark, sf, "contexts", lambda: RV.context_records(_contexts(spark, sf)))


def _drafts_written(spark, sf):
    return _written(spark, sf, "drafts", lambda: _drafts(spark, sf))


@register("sink_cases", None)
def q_sink_cases(spark, sf):
    path, df, _ = _cases_written(spark, sf)
    return spark.read.schema(df.schema).json(path)


@register("src_cases_json", None)
def q_src_cases_json(spark, sf):
    path, df, _ = _cases_written(spark, sf)
    return FS.read_json_records(spark, path, df.schema)


@register("sink_contexts", None)
def q_sink_contexts(spark, sf):
    path, df, _ = _contexts_written(spark, sf)
    return spark.read.schema(df.schema).json(path)


@register("sink_drafts", None)
def q_sink_drafts(spark, sf):
    path, _, _ = _drafts_written(spark, sf)
    return FS.read_json_records(spark, path, DRAFT_RECORD)


@register("sink_cases_flat", mixed_sql(
    f"SELECT printf('ELL-%03d', draw) AS id, {_BAND} AS riskBand, in_degree AS inDegree, {round_share_sql('two_hop_risk_neighbor_share')} AS twoHopShare, "
    + " + ".join(f"CAST({r}_hit AS INTEGER)" for r in C.SUPPORTED_RULE_IDS) + " AS n_rules FROM queue"))
def q_sink_cases_flat(spark, sf):
    return q_sink_cases(spark, sf).select(
        "id", "riskBand", F.col("graphContext.inDegree").alias("inDegree"), F.col("graphContext.twoHopRiskNeighborShare").alias("twoHopShare"),
        F.size("triggeredRules").alias("n_rules"))


@register("sink_contexts_flat", mixed_sql(
    f"SELECT id AS txId, risk_score, {_REQ_RULES} AS rules, coalesce(CASE WHEN R001_hit THEN total_degree END, -1) AS r001_degree, "
    f"{D.q(', '.join(C.UNSUPPORTED_MISSING_FIELDS))} AS unsupported FROM queue"))
def q_sink_contexts_flat(spark, sf):
    c = q_sink_contexts(spark, sf)
    first = F.filter("triggered_rules", lambda r: r["rule_id"] == "R001")
    return c.select(
        F.col("review_object.txId").alias("txId"), F.col("risk.risk_score").alias("risk_score"),
        F.array_join(F.transform("triggered_rules", lambda r: r["rule_id"]), ",").alias("rules"),
        F.coalesce(F.get(first, 0)["evidence_fields"]["total_degree"], F.lit(-1)).cast("long").alias("r001_degree"),
        F.array_join(F.col("unsupported_rules")[0]["evidence_fields"]["missing_fields"], ", ").alias("unsupported"))


@register("sink_drafts_flat", _MERGE_SQL)
def q_sink_drafts_flat(spark, sf):
    return _draft_flat(q_sink_drafts(spark, sf))


@register("sink_queue", mixed_sql(f"SELECT {cols(SCORED_COLS)}, f_001, f_002, f_003, {cols(EXPOSURE_COLS)}, draw FROM queue"))
def q_sink_queue(spark, sf):
    path, df, _ = _written(spark, sf, "queue", lambda: mixed_queue(spark, sf).select(
        *SCORED_COLS, "f_001", "f_002", "f_003", *EXPOSURE_COLS, "draw"))
    return spark.read.option("header", "true").schema(K.flatten_for_csv(df).schema).csv(path)


@register("sink_counts", mixed_sql("SELECT count(*) AS cases, count(*) AS contexts, count(*) AS drafts FROM sample"))
def q_sink_counts(spark, sf):
    """K5: rows observed while the outputs are written."""
    counts = {"cases": _cases_written(spark, sf)[2], "contexts": _contexts_written(spark, sf)[2], "drafts": _drafts_written(spark, sf)[2]}
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()])


@register("sink_drafts_extra", _wsql([_RESP], "SELECT q.id AS txId, CASE WHEN m = 1 THEN 'x' END AS summary_zh FROM queue q LEFT JOIN resp r USING (id)"))
def q_sink_drafts_extra(spark, sf):
    """A key that only a model's answer has, at top level of the written record."""
    path, _, _ = _drafts_written(spark, sf)
    return FS.read_json_records(spark, path, "txId long, summary_zh string")


def _summary(spark, sf):
    k = _key(spark, sf, "summary")
    if k not in _memo:
        g = graph(spark, sf)
        comp, _ = G.connected_components(g.ids, g.edges)
        cases = S.sample_merged(scored(spark, sf), ["risk_level"], [SEED, SEED + 1], C.PER_STRATUM)
        record = SU.summary_record(g.nodes, g.edges, g.labels, G.component_summary(comp, g.ids), cases, g.steps)
        path = scratch_path(spark, "summary")
        K.put_json(record, path)
        _memo[k] = path
    return _memo[k]


_SUM_SQL = "WITH " + ",\n".join(D.ctes() + [f"mrg AS ({_MERGED_BODY})"]) + "\n" + (
    "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(DISTINCT time_step) FROM g_nodes) AS steps, "
    "(SELECT min(time_step) FROM g_nodes) AS first_step, (SELECT max(time_step) FROM g_nodes) AS last_step, "
    "(SELECT count(*) FROM metrics WHERE label_name = 'licit') AS licit, (SELECT count(*) FROM metrics WHERE label_name = 'unknown') AS unknown, "
    "(SELECT count(*) FROM metrics WHERE label_name = 'illicit') AS illicit, "
    "(SELECT round(2.0 * (SELECT count(*) FROM g_edges) / count(*), 4) FROM g_nodes) AS degree, (SELECT count(*) FROM mrg) AS cases, "
    f"(SELECT count(*) FROM mrg WHERE {_BAND} = 'high') AS high, (SELECT count(*) FROM mrg JOIN metrics USING (id) WHERE label_name = 'unknown') AS unknown_cases")


@register("sink_summary", _SUM_SQL)
def q_sink_summary(spark, sf):
    """The dataset summary written as one record and read back with its declared schema."""
    r = FS.read_json_records(spark, _summary(spark, sf), DATASET_SUMMARY)
    label = lambda x: F.col("labelDistribution")[x]
    return r.select(
        F.col("keyFactors.nodeCount").alias("nodes"), F.col("keyFactors.directedEdgeCount").alias("edges"), F.col("keyFactors.timeStepCount").alias("steps"),
        F.col("keyFactors.timeStepRange")[0].alias("first_step"), F.col("keyFactors.timeStepRange")[1].alias("last_step"),
        label("licit").alias("licit"), label("unknown").alias("unknown"), label("illicit").alias("illicit"),
        F.col("graphSummary.averageDirectedDegreeApprox").alias("degree"), F.col("generatedDemoCaseSummary.maxDemoCases").alias("cases"),
        F.col("generatedDemoCaseSummary.riskBandDistribution")["high"].alias("high"),
        F.col("generatedDemoCaseSummary.demoLabelDistribution")["unknown"].alias("unknown_cases"))


@register("pipeline_run", D.with_sql(" UNION ALL ".join(
    f"SELECT '{o}' AS output, count(*) AS rows FROM sample" for o in ("cases", "contexts", "drafts", "queue", "requests"))
    + " UNION ALL SELECT 'drafts from the model' AS output, count(*) FILTER (WHERE draw % 7 IN (1, 3, 4, 5)) AS rows FROM sample"))
def q_pipeline_run(spark, sf):
    from riskgraph.sources.tables import load_corpus_pages

    root = _raw_inputs(spark, sf)
    out = scratch_path(spark, "run")
    opts = P.RunOptions(skip_top=SKIP, batch_size=BATCH, seed=SEED, n_features=3,
                        rule_keywords=C.DRIVER_RULE_KEYWORDS, default_keywords=C.DRIVER_DEFAULT_KEYWORDS)

    def answers(requests):
        # the drawn cases stand in the written queue (a repeated id once per draw), so nothing is scored a second time
        queue = spark.read.option("header", "true").csv(f"{out}/human_review_queue").select(F.col("id").cast("long"), F.col("draw").cast("int"))
        return queue.distinct().where("draw % 7 <> 0").select("id", F.expr(_ANSWER).alias("content"))

    written = P.run(spark, root, load_corpus_pages(spark, sf), out, opts, responses=answers)
    drafts = spark.read.json(f"{out}/review_drafts").where("llm_status = 'success'")
    return written.select("output", "rows").unionByName(
        drafts.agg(F.lit("drafts from the model").alias("output"), F.count(F.lit(1)).alias("rows")))


def queries() -> dict[str, QueryFn]:
    return {k: fn for k, (fn, _sql) in REG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_fn, sql) in REG.items() if sql is not None}
