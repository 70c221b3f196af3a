import duckdb
import numpy as np
from pyspark.sql import functions as F

from riskgraph.llm import quality_eb as Q
from riskgraph.llm import queries

from .helpers import awkward_docs, awkward_texts, no_docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy():
    data = duckdb.sql(f"select text, quality from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    x, y = np.stack([Q.features(t) for t, _ in data]), np.array([q for _, q in data], float)
    train = np.arange(len(y)) % 2 == 0
    mean, scale, w, c = Q.fit_logistic(x[train], y[train])
    right = (((x[~train] - mean) / scale) @ w + c >= 0) == (y[~train] == 1)
    assert right.mean() > 0.97


def test_query_keeps_good_documents(spark):
    got = {r["doc_id"]: r["kept"] for r in queries.op3_quality_eb(spark, SF).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert len(got) == 1000
    assert np.mean([got[i] for i, q in labels.items() if q == 1]) > 0.99
    assert np.mean([got[i] for i, q in labels.items() if q == 0]) < 0.05


def scored(spark, data):
    return spark.createDataFrame(data, "__host string, __path string, __good double, n int")


def test_sparse_sites_follow_their_parents(spark):
    rng = np.random.default_rng(4)
    data = [("big", "p", float(g), 1) for g in rng.beta(8, 2, 400)] + [("bad", "p", float(g), 1) for g in rng.beta(2, 8, 400)]
    data += [("bad", "lone", 0.9, 2), ("new", "q", 0.5, 3), ("big", "p", None, 4)]
    out = {(r["n"]): r for r in Q.posteriors(scored(spark, data)).where("n > 1").collect()}
    mean = np.mean([g for *_, g, _ in data if g is not None])
    assert out[2]["path_posterior"] < 0.35, "one good document in a bad host is judged by the host"
    assert abs(out[3]["path_posterior"] - mean) < 0.02, "a site of its own falls back to the global mean"
    assert out[4]["kept"] is False and out[4]["path_posterior"] > 0.7


def test_posterior_formula(spark):
    data = [("a", "x", 0.9, 0), ("a", "x", 0.8, 0), ("a", "y", 0.4, 0), ("b", "x", 0.2, 0), ("b", "z", 0.3, 7)]
    table = scored(spark, data)
    row = Q.posteriors(table).where("n = 7").first()
    path = table.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), F.sum("__good").alias("s"), F.sum(F.col("__good") ** 2).alias("q"))
    host = path.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, kh, kp = 2.6 / 5, Q._shrinkage(host), Q._shrinkage(path)
    h = (0.2 + kh * mean) / (1 + kh)
    p = (0 + kp * h) / (0 + kp)
    logit = lambda v: np.log(v / (1 - v))
    assert np.allclose([row["host_posterior"], row["path_posterior"], row["score"]], [h, p, logit(0.3) + logit(p) - logit(mean)])


def test_awkward_rows(spark):
    docs = awkward_docs(spark).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(7, True), (14, False), (9, True), (2, None)], "doc_id long, good boolean")
    out = Q.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(awkward_texts()) and out[0]["label"] == "l"
    assert all(r["kept"] is False for r in out if not (r["text"] or "").strip())
    untrained = Q.classify(docs, labels.where("good"), F.col("source"), F.col("lang"), carry=["doc_id", "text"]).collect()
    assert all(r["kept"] == bool((r["text"] or "").strip()) for r in untrained)
    assert Q.classify(no_docs(spark), labels, F.col("source"), F.col("lang")).collect() == []


def brute_posteriors(rows):
    """(host, path, evidence) rows -> (host posterior, path posterior, score), with sums over lists."""
    import math
    from collections import defaultdict

    good = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, p, _), g in zip(rows, good):
        hosts[h].append(g)
        paths[h, p].append(g)
    mean = sum(good) / len(good)
    square = lambda groups, about: sum(len(v) * (sum(v) / len(v) - about(k)) ** 2 for k, v in groups.items())
    inside = lambda groups: sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in groups.values())

    def k(groups, about, free, size):
        within = max(inside(groups) / (len(good) - len(groups)), 1e-9)
        return within / max((square(groups, about) / free - within) / (size / free), 1e-3 * within)

    k_host = k(hosts, lambda h: mean, len(hosts) - 1, len(good) - sum(len(v) ** 2 for v in hosts.values()) / len(good)) if len(hosts) > 1 else 1e3
    nested = sum(sum(len(v) ** 2 for key, v in paths.items() if key[0] == h) / len(own) for h, own in hosts.items())
    k_path = (k(paths, lambda key: sum(hosts[key[0]]) / len(hosts[key[0]]), len(paths) - len(hosts), len(good) - nested)
              if len(paths) > len(hosts) else 1e3)
    logit = lambda p: math.log(p / (1 - p))
    out = []
    for (h, p, e), g in zip(rows, good):
        a = (sum(hosts[h]) - g + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        b = (sum(paths[h, p]) - g + k_path * a) / (len(paths[h, p]) - 1 + k_path)
        out.append((a, b, e + logit(b) - logit(mean)))
    return out, k_path


def test_query_posteriors_match_brute_force(spark):
    from riskgraph.llm import queries

    got = queries.op3_quality_eb(spark, "/root/testdata/sf0.001").collect()
    want, _ = brute_posteriors([(r["source"], r["lang"], r["evidence"]) for r in got])
    for r, (a, b, score) in zip(got, want):
        assert abs(r["host_posterior"] - a) < 1e-6 and abs(r["path_posterior"] - b) < 1e-6 and abs(r["score"] - score) < 1e-5
        assert r["kept"] == (r["score"] >= 0)


def test_paths_are_shrunk_within_their_hosts(spark):
    """Two hosts far apart, paths of one host alike: nothing tells paths apart, so their k is large."""
    rows = [(h, p, base + 0.02 * ((7 * i) % 11 - 5)) for h, base in (("a", 0.2), ("b", 0.8)) for p in "xyz" for i in range(40)]
    table = spark.createDataFrame([(h, p, g) for h, p, g in rows], "__host string, __path string, good double")
    F = Q.F
    paths = table.groupBy("__host", "__path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").alias("s"), F.sum(F.col("good") ** 2).alias("q"))
    assert Q._nested_shrinkage(paths) > 500 and Q._shrinkage(paths) < 1


def test_repeated_ids_fit_alike_whatever_the_partitions(spark):
    docs = [(i % 30, f"text number {i} " + ("good words here " if i % 2 else "zz zz zz ") * (1 + i % 5)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(30)], "doc_id long, good boolean")
    fits = [Q.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, rows=50) for n in (1, 5)]
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(*fits))
