"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: a logistic model over byte shares and repetition measures of the whole text,
fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``; the sample is the rows with the smallest
hash of their id, ids that repeat by the digest of their text).  Evidence of its place: documents sit in paths (here the language section) of hosts.
Mean goodness per host is shrunk toward the global mean, mean goodness per path toward its host, each by
n / (n + k), where k is the ratio of variance within sites to variance between them, estimated from
grouped sums (nested analysis of variance: hosts about the global mean, paths about their host).  Sparse sites thus follow their parent.  A document is
left out of the means it is judged by.  Its posterior log odds are its own evidence plus the log odds of
its path against the global ones.

Only the fit touches the driver (a bounded matrix).  Sums per site are partial aggregates; the sites'
table is written before it is joined, so Spark sees its size and splits a hot host's rows.

Defined results: null text counts as empty, and an empty text is rejected; null host or path are sites
of their own; without both classes among the labels the evidence is the global prior and nothing but
empty texts is rejected; repeated rows each get a row and count each; extra columns are carried by
:func:`classify` unless named like its outputs.  Very long texts cost linear time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskgraph.llm.tables import discard, written

SAMPLE_ROWS = 8000
N_FEATURES = 256 + 12
OUTPUTS = ("evidence", "host_posterior", "path_posterior", "score", "kept")


def features(text: str) -> np.ndarray:
    """Square roots of byte shares, then length and repetition measures."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = text.encode("utf-8")
    words = text.split()
    n = len(words)
    if not n:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    bodies = "".join(words)
    pairs = len(set(zip(words, words[1:])))
    out[256:] = (
        np.log1p(n), len(bodies) / n / 10, len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, pairs / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(map(str.isupper, words)) / n, sum(not w[-1].isalnum() for w in words) / n,
        sum(len(w) == 1 for w in words) / n, n < 20)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, intercept) by Newton's method on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = np.inf
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS):
    """Model from ``labels`` (id, good boolean); None unless both classes occur in the sample."""
    sample = labels.where(F.col("good").isNotNull()).select(F.col(id_col).alias("id"), "good").orderBy(
        F.xxhash64("id"), "id", "good").limit(rows)
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(sample), "id").select("text", "good", F.xxhash64("id").alias("h"), F.md5("text").alias("digest"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t).tobytes() for t in b.column(0).to_pylist()], pa.binary()), *b.columns[1:]], names=["x", "good", "h", "digest"])

    order = ["h", "digest", "good"]
    got = chosen.mapInArrow(run, "x binary, good boolean, h long, digest string").orderBy(*order).limit(rows).select("x", "good").collect()
    y = np.array([r["good"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit_logistic(np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), -1), y)


def with_goodness(docs: DataFrame, model, text_col: str = "text", out_col: str = "__good") -> DataFrame:
    """All columns plus the probability of being good by the text alone (null for a text without words)."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType(), True)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.slice(i, 128)
                texts = [t or "" for t in part.column(at).to_pylist()]
                good = np.full(len(texts), 0.5)
                if shared.value is not None:
                    mean, scale, w, c = shared.value
                    x = np.stack([features(t) for t in texts])
                    good = 1 / (1 + np.exp(-np.clip(((x - mean) / scale).astype(np.float64) @ w + c, -30, 30)))
                good = pa.array([float(g) if t.strip() else None for g, t in zip(good, texts)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, good], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def _shrinkage(groups: DataFrame) -> float:
    """k: variance within groups over variance between them, from (n, s, q) = rows, sum and sum of squares per group."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    r = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(q).alias("q"), F.count(F.lit(1)).alias("g"),
                   F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn")).first()
    if not r["n"] or r["g"] < 2 or r["n"] <= r["g"]:
        return 1e3
    within = max((r["q"] - r["b"]) / (r["n"] - r["g"]), 1e-9)
    between = (r["b"] - r["s"] ** 2 / r["n"]) / (r["g"] - 1)
    size = (r["n"] - r["nn"] / r["n"]) / (r["g"] - 1)
    return within / max((between - within) / size, 1e-3 * within)


def _nested_shrinkage(paths: DataFrame) -> float:
    """k of paths within their hosts, from (__host, n, s, q) per path: host means take out what hosts differ by."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    hosts = paths.groupBy("__host").agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(q).alias("q"), F.count(F.lit(1)).alias("g"),
                                        F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn"))
    r = hosts.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("h"), F.sum("b").alias("b"),
                  F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hb"), F.sum(F.col("nn") / F.col("n")).alias("nn")).first()
    if not r["n"] or r["g"] <= r["h"] or r["n"] <= r["g"]:
        return 1e3
    within = max((r["q"] - r["b"]) / (r["n"] - r["g"]), 1e-9)
    between = (r["b"] - r["hb"]) / (r["g"] - r["h"])
    size = (r["n"] - r["nn"]) / (r["g"] - r["h"])
    return within / max((between - within) / size, 1e-3 * within)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, good_col: str = "__good") -> DataFrame:
    """``scored`` (a written table with __host, __path and goodness) with the columns of ``OUTPUTS``."""
    good = F.col(good_col)
    path = scored.where(good.isNotNull()).groupBy("__host", "__path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(good).alias("s"), F.sum(good * good).alias("q"))
    path = written(path, "site_paths")
    host = path.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = host.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    k_host, k_path = _shrinkage(host), _nested_shrinkage(path)
    sites = written(path.select("__host", "__path", F.col("n").alias("__pn"), F.col("s").alias("__ps")).join(
        host.select("__host", F.col("n").alias("__hn"), F.col("s").alias("__hs")), "__host"), "sites")
    own = F.coalesce(good, F.lit(mean))
    one = F.when(good.isNotNull(), 1.0).otherwise(0.0)  # the document itself, left out
    discard(path)
    out = scored.join(sites, ["__host", "__path"], "left")
    n, s = lambda c: F.coalesce(F.col(c), F.lit(0.0)) - one, lambda c: F.coalesce(F.col(c), F.lit(0.0)) - one * own
    out = out.withColumn("evidence", _logit(own))
    out = out.withColumn("host_posterior", (s("__hs") + k_host * mean) / (n("__hn") + k_host))
    out = out.withColumn("path_posterior", (s("__ps") + k_path * F.col("host_posterior")) / (n("__pn") + k_path))
    out = out.withColumn("score", F.col("evidence") + _logit(F.col("path_posterior")) - float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
    return out.withColumn("kept", good.isNotNull() & (F.col("score") >= 0)).drop(
        "__host", "__path", "__hn", "__hs", "__pn", "__ps", good_col)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str] | None = None, id_col: str = "doc_id",
             text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default all but those named like outputs) plus evidence, host_posterior, path_posterior,
    score (posterior log odds of being good) and kept."""
    model = fit(docs, labels, id_col, text_col, rows)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    sited = docs.select(*carry, *([] if text_col in carry else [text_col]), host.alias("__h"), path.alias("__p"))
    scored = with_goodness(sited, model, text_col)
    mark = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), c))  # noqa: E731  joins need a value
    scored = scored.select(*carry, mark("__h").alias("__host"), mark("__p").alias("__path"), "__good")
    return posteriors(written(scored, "goodness")).select(*carry, *OUTPUTS)
