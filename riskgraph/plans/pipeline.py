"""Composite plans: node metrics (C1), scored nodes (C2), review queue
and the full run (C11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskgraph.operators.metrics import node_metrics
from riskgraph.operators.profile import assign_segments
from riskgraph.operators.rules import apply_weights, evaluate_rules, score_and_level, score_rule_table
from riskgraph.operators.thresholds import join_thresholds, threshold_wide
from riskgraph.session import materialize
from riskgraph.sources.tables import GraphInputs


@dataclass(frozen=True)
class ScoreOptions:
    weights: str = "published"      # or "literal"
    materialize: bool = True        # write node metrics once (shared checkpoint dir)
    rules: DataFrame | None = None          # own rules: (rule_id, predicate), scored with
    rule_weights: DataFrame | None = None   # (primary_segment, rule_id, weight)


def materialized(df: DataFrame, opts: ScoreOptions) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    The metrics frame feeds three consumers (global cut-offs, peer
    thresholds, the scored rows); writing it once avoids recomputing the
    degree aggregation and the label join per consumer and survives the loss
    of executors.
    """
    if not opts.materialize:
        return df
    return materialize(df, "node_metrics")


def segmented_nodes(g: GraphInputs, opts: ScoreOptions = ScoreOptions()) -> DataFrame:
    metrics = materialized(node_metrics(g.nodes, g.edges, g.labels), opts)
    return assign_segments(metrics)


def scored_nodes(g: GraphInputs, opts: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Metrics -> segment -> peer thresholds -> rules -> weights -> score -> level.

    With a rule table of the caller's own, hits and scores are in ``rule_hits`` instead of one column per rule.
    """
    seg = segmented_nodes(g, opts)
    wide = threshold_wide(seg)
    df = join_thresholds(seg, wide)
    if opts.rules is not None:
        return score_rule_table(df, opts.rules, opts.rule_weights)
    df = evaluate_rules(df)
    df = apply_weights(df, opts.weights)
    df = score_and_level(df)
    return df


@dataclass(frozen=True)
class RunOptions:
    skip_top: int = 5000
    batch_size: int = 100
    seed: int = 42
    weights: str = "published"
    n_features: int = 165
    rule_keywords: dict | None = None
    default_keywords: list | None = None


def review_queue(scored: DataFrame, g: GraphInputs, opts: RunOptions = RunOptions()) -> DataFrame:
    """Sample (skip, pool, seeded draw) -> exposure for the sampled ids only.

    The drawn rows are written first, so the pool and the draw run once.
    Exposure does not feed the rules, so it is computed after sampling; its
    one- and two-hop joins then touch only the sample's neighbourhoods, and the
    features are brought back for the sample alone.  The queue is small (batch
    rows) and reused by every review output, so it is written as well.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskgraph.operators import sampling as S

    cases = S.sample_cases(scored, opts.skip_top, opts.batch_size, opts.seed)
    cases = cases.withColumn("draw", F.row_number().over(Window.orderBy(S.draw_key(opts.seed), F.col("id"))))
    return queue_of(cases, g)


def queue_of(cases: DataFrame, g: GraphInputs) -> DataFrame:
    """Drawn scored rows with their features and exposure."""
    from riskgraph.operators import graph as G
    from riskgraph.operators.metrics import features_of

    cases = materialize(cases, "drawn")
    exp = G.exposure(cases.select("id"), G.adjacency(g.edges), G.risky_nodes(g.ids, g.labels))
    return materialize(cases.join(features_of(cases, g.nodes_of(cases)), "id").join(exp, "id"), "review_queue")


def run(spark, data_dir: str, pages: DataFrame, out_dir: str, opts: RunOptions = RunOptions(),
        responses=None) -> DataFrame:
    """C11: discover inputs -> load -> score -> sample -> exposure -> retrieval ->
    contexts -> draft requests -> drafts -> cases -> write all outputs.  Returns (output, path, rows).

    ``responses``: (id, content) of model answers, or a function that takes the written requests
    (id, system, user, temperature) and returns them; without, every draft is the template.  Such a function
    finds the written queue in ``out_dir``.
    """
    from pyspark.sql import functions as F

    from riskgraph import sinks
    from riskgraph.operators import cases as CA
    from riskgraph.operators import corpus as CO
    from riskgraph.operators import review as RV
    from riskgraph.sources import files

    found = {r["key"]: r["path"] for r in files.discover(spark, data_dir).collect()}  # one row per input
    missing = set(files.INPUT_NAMES) - set(found)
    if missing:
        raise FileNotFoundError(f"inputs not found under {data_dir}: {sorted(missing)}")
    # nodes and edges are read many times (degrees, steps, features, both hops), so their text is parsed once
    g = GraphInputs(
        nodes=materialize(files.read_nodes(spark, found["features"], opts.n_features), "run_nodes"),
        edges=materialize(files.read_edges(spark, found["edges"]), "run_edges"),
        labels=files.read_labels(spark, found["classes"]),
    )
    sc = scored_nodes(g, ScoreOptions(weights=opts.weights))
    queue = review_queue(sc, g, opts)
    chunks = CO.corpus_chunks(spark, pages)
    retrieved = CO.retrieve_for_cases(queue, chunks, rule_keywords=opts.rule_keywords,
                                      default_keywords=opts.default_keywords)
    contexts = materialize(RV.review_contexts(queue, retrieved), "contexts")
    cases = CA.case_records(queue)
    out = out_dir.rstrip("/")
    requests = f"{out}/draft_requests"
    written = {"requests": (requests, sinks.put_json(RV.draft_requests(contexts), requests)),
               "queue": (f"{out}/human_review_queue", sinks.put_csv(queue, f"{out}/human_review_queue"))}
    if callable(responses):
        responses = responses(spark.read.json(requests))
    drafts = RV.fallback_drafts(contexts) if responses is None else RV.merge_drafts(contexts, responses)
    # internal join keys and helper columns are not written (case records show only the masked id)
    for name, folder, write, frame in (
        ("cases", "aml_demo_cases", sinks.put_json, cases.drop("txId")),
        ("contexts", "rag_contexts", sinks.put_contexts, RV.context_records(contexts)),
        ("drafts", "review_drafts", sinks.put_drafts, drafts),
    ):
        written[name] = (f"{out}/{folder}", write(frame, f"{out}/{folder}"))
    # rows were counted while they were written
    rows = [(name, path, count) for name, (path, count) in written.items()]
    return spark.createDataFrame(rows, "output string, path string, rows long")
