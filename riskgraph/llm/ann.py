"""Approximate nearest neighbours by learned partitions.

1. Fit, on a bounded sample (``SAMPLE`` vectors with the smallest hash of their id): the neighbour graph
   of the sample is split into parts of nearly equal size by median splits along principal directions,
   improved by moving vectors to the part that most of their neighbours are in while parts stay within
   their size.  A small network (one hidden layer) learns to tell the parts of a vector's neighbours from
   the vector.  How many parts a query visits is set on held-out sample vectors: the fewest that hold
   ``TARGET`` of their true neighbours.
2. Index: every vector of the table goes to its most probable part.
3. Search: a query visits its most probable parts.  Parts are dealt into blocks of bounded size, as are the
   queries that visit a part, and every (part, block, query block) is one small group of rows: scores by
   matrix product choose candidates, which are then scored exactly, one fixed order of additions for every
   pair, so that equal vectors tie exactly.  The best of each block are merged per query.

Parts grow in number with the table (one per ``PART_ROWS`` rows, up to ``MAX_PARTS``); a part that holds very
many copies of one vector is just more blocks, and in a block only as many copies of one vector as can be
in an answer are compared (those with the smallest ids, so nothing is lost).

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or
non-finite components take no part; ids that are null take none either; rows that repeat an id count once, with the
smallest of their vectors in the order of arrays; ties go to the smaller id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.tables import written

SAMPLE = 8192
PART_ROWS, MAX_PARTS = 3200, 256
BLOCK, QUERY_BLOCK = 4096, 1024
NEIGHBOURS = 10
TARGET = 0.96
RESULT = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that take part; v as array<double>."""
    v = F.col(vec_col)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    inf = float("inf")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))


def exact_neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of x with the largest inner products with rows ``queries`` of x, the row itself left out."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 512):
        q = queries[i:i + 512]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        out[i:i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Part of every row: balanced splits, then neighbour majority under a size limit."""
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        split(order[:cut], first, n // 2)
        split(order[cut:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    most = math.ceil(1.1 * len(x) / parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Softmax network with one hidden layer: probabilities of parts for vectors."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(np.sqrt((x**2).sum(axis=1).mean()), 1e-30)
        d, m = x.shape[1], target.shape[1]
        w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)) * np.sqrt(d), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, m)), np.zeros(m)]
        first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                z, t = x[order[i:i + 256]] * self.scale, target[order[i:i + 256]]
                h = np.maximum(z @ w[0] + w[1], 0)
                e = (self._softmax(h @ w[2] + w[3]) - t) / len(z)
                back = (e @ w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(axis=1, keepdims=True))
        return a / a.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def fit(x: np.ndarray, parts: int) -> tuple[Router | None, int]:
    """(router, parts a query visits) from a sample of vectors."""
    parts = min(parts, len(x) // 32)
    if parts < 2:
        return None, 1
    graph = exact_neighbours(x, np.arange(len(x)), min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    held = np.arange(len(x)) % 5 == 0
    tried = Router(x[~held], target[~held])
    # neighbours sit where the router puts them, so that is what a visit must reach
    chance = tried(x)
    seat = chance.argmax(axis=1)
    rank = np.argsort(np.argsort(-chance[held], axis=1, kind="stable"), axis=1)
    reached = rank[np.arange(held.sum())[:, None], seat[graph[held]]]
    visits = next(t for t in range(1, parts + 1) if (reached < t).mean() >= TARGET or t == parts)
    return Router(x, target), max(min(3, parts), visits)


def routed(rows: DataFrame, router: Router | None, visits: int) -> DataFrame:
    """``rows`` (id, v) with the part of each of the ``visits`` most probable parts."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        for b in batches:
            chosen = np.zeros((len(b), 1), np.int32)
            if shared.value is not None and len(b):
                x = b.column(1).flatten().to_numpy().reshape(len(b), -1)
                chosen = np.argsort(-shared.value(x), axis=1, kind="stable")[:, :visits].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(chosen), pa.list_(pa.int32()))], names=["id", "v", "parts"])

    out = rows.mapInArrow(run, "id long, v array<double>, parts array<int>")
    return out.select("id", "v", F.explode("parts").alias("part"))


def _few_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows left when of equal vectors only the ``most`` smallest ids stay; ids are sorted."""
    group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    new = np.diff(group[order], prepend=-1) != 0
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - first < most])


def best_pairs(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best candidates other than itself."""
    qid, at = np.unique(qid, return_index=True)
    q = q[at]
    cid, at = np.unique(cid, return_index=True)
    c = c[at]
    few = _few_copies(cid, c, k + 1)
    cid, c = cid[few], c[few]
    out = []
    for i in range(0, len(q), 128):
        a, ids = q[i:i + 128], qid[i:i + 128]
        s = a @ c.T
        s[ids[:, None] == cid[None, :]] = -np.inf
        size = np.abs(a) @ np.abs(c).max(axis=0) * 1e-12
        limit = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] - size
        row, col = np.nonzero((s >= limit[:, None]) & (s > -np.inf))
        exact = np.zeros(len(row))
        for d in range(c.shape[1]):
            exact += a[row, d] * c[col, d]
        order = np.lexsort((cid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        start = np.searchsorted(row, np.arange(len(a)))
        top = np.arange(len(row)) - start[row] < k
        out.append((ids[row[top]], cid[col[top]], exact[top]))
    return tuple(np.concatenate([p[j] for p in out]) for j in range(3))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows by inner product to every row that ``is_query`` (a
    condition on column id) selects."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one row for each id, aggregated before the shuffle
    rows = written(rows.where(F.size("v") == width["w"]).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    width = {"n": rows.count()}
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    router, visits = fit(sample, min(MAX_PARTS, math.ceil(width["n"] / PART_ROWS)))
    index = written(routed(rows, router, 1), "index")
    asked = written(routed(rows.where(is_query), router, visits), "queries")
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_PARTS rows
    visitors = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not visitors:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = spark.createDataFrame([(p, math.ceil(n / BLOCK), math.ceil(visitors[p] / QUERY_BLOCK)) for p, n in sizes.items() if p in visitors],
                                   "part int, blocks int, query_blocks int")

    def dealt(part: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        """A row for every group it belongs to."""
        return part.join(F.broadcast(blocks), "part").select(
            "part", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.lit(query).alias("query"), "id", "v")

    both = dealt(index, "blocks", "query_blocks", False).unionByName(dealt(asked, "query_blocks", "blocks", True))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["query"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best_pairs(ids[asks], x[asks], ids[~asks], x[~asks], k))))

    found = both.groupBy("part", "blocks", "query_blocks").applyInPandas(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
