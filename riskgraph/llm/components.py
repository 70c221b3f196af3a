"""Connected components by contraction, every step a written table.

Each round points every node at its smallest neighbour (or itself), follows the pointers to their roots by
doubling, replaces nodes by roots in the edges and drops what has become a loop or a repeat.  Edges and
nodes shrink at least by half per round, and rounds end when no edge is left; there is no cap.  Pointers are
written before every join, so Spark knows their size and can split the rows of a node that very many edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.tables import discard, written


def _roots(edges: DataFrame) -> DataFrame:
    """(node, label, before): every node of the edges with the root of its chain of smallest neighbours."""
    both = edges.select(F.col("x").alias("node"), F.col("y").alias("near")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("x").alias("near")))
    pointer = written(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("label")), "pointers")
    while True:
        jump = pointer.select(F.col("node").alias("at"), F.col("label").alias("next"))
        after = written(pointer.join(jump, pointer["label"] == jump["at"]).select(
            "node", F.col("next").alias("label"), F.col("label").alias("before")), "pointers")
        discard(pointer)
        pointer = after
        if pointer.where("label != before").isEmpty():
            return pointer


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label, ...) of every node that has an edge to another; label is the smallest node of its component."""
    edges = written(edges.where(F.col(a) != F.col(b)).select(*_ordered(a, b)).distinct(), "component_edges")
    labels = None
    while labels is None or not edges.isEmpty():
        roots = _roots(edges)
        of = lambda end: roots.select(F.col("node").alias(end), F.col("label").alias("root_" + end))
        met = edges.join(of("x"), "x").join(of("y"), "y").where("root_x != root_y").select(*_ordered("root_x", "root_y")).distinct()
        met = written(met, "component_edges")
        discard(edges)
        edges = met
        if labels is None:
            labels = roots
            continue
        up = roots.select(F.col("node").alias("at"), F.col("label").alias("root"))
        after = written(labels.join(up, labels["label"] == up["at"], "left").select("node", F.coalesce("root", "label").alias("label")),
                        "component_labels")
        discard(labels, roots)
        labels = after
    discard(edges)
    return labels
