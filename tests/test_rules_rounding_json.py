"""Own rule tables, Python's rounding and JSON text, population ranks, threshold top-k."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import config as C
from riskgraph.functions.pyjson import json_text
from riskgraph.functions.rounding import python_round_ratio, ratio_sql, round_share
from riskgraph.operators import cases as CA
from riskgraph.operators import corpus as CO
from riskgraph.operators import rules as R
from riskgraph.plans import catalog
from riskgraph.session import materialize
from riskgraph.sources.tables import load_corpus_pages

SF = "/root/testdata/sf0.001"


def test_rounding_equals_python(spark):
    import duckdb

    r = random.Random(1)
    pairs = [(n, d) for d in range(1, 161) for n in range(d + 1)] + [(1, 32), (1, 160), (3, 32000), (1, 2 * 10**4 * 7)]
    pairs += [(r.randrange(10**9), r.randrange(1, 10**9)) for _ in range(500)]
    pairs += [(2 * k + 1, 20000 * m) for k in range(300) for m in (1, 3, 64)]  # ties of the quotient and near ones
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", python_round_ratio(F.col("n"), F.col("d"), 4).alias("x")).collect()
    assert [x.x for x in got] == [round(x.n / x.d, 4) for x in got]
    assert {(x.n, x.d): x.x for x in got}[1, 32] == 0.0312 and {(x.n, x.d): x.x for x in got}[1, 160] == 0.0063
    con = duckdb.connect()
    con.execute("CREATE TABLE t(n BIGINT, d BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs[:3000] + pairs[-900:])
    assert all(x == round(n / d, 4) for n, d, x in con.execute(f"SELECT n, d, {ratio_sql('n', 'd', 4)} FROM t").fetchall())
    shares = spark.range(10001).select((F.col("id") / 10000).alias("s")).select("s", round_share(F.col("s")).alias("x")).collect()
    assert all(x.x == round(x.s, 2) for x in shares)


def test_json_text_equals_json_dumps(spark):
    texts = ["", "plain", 'quote " slash \\ /', "line\nfeed\ttab\r\b\f", "\x00\x01\x1f\x7f", "é中😀  ", "a" * 3000]
    rows = [(t, [t, None], ({"k\n": 1.5} if i % 2 else {"é": None}), float(i) / 7, i, i % 2 == 0, (t, 1e22)) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None), ("n", [], {}, float("nan"), -5, True, (None, float("inf"))), ("x", ["y"], {"z": 0.1}, -0.0, 2**60, False, ("", 1e-7))]
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("a", T.ArrayType(T.StringType())),
                           T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("d", T.DoubleType()),
                           T.StructField("i", T.LongType()), T.StructField("b", T.BooleanType()),
                           T.StructField("o", T.StructType([T.StructField("t", T.StringType()), T.StructField("x", T.DoubleType())]))])
    df = spark.createDataFrame(rows, schema)
    got = df.select(*[json_text(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]).collect()
    for r, g in zip(rows, got):
        want = [*r[:6], None if r[6] is None else {"t": r[6][0], "x": r[6][1]}]
        assert list(g) == [json.dumps(v) for v in want]


def test_request_text_equals_json_dumps(spark):
    q = {r.id: r for r in catalog.mixed_queue(spark, SF).collect()}
    requests = catalog.queries()["draft_requests"](spark, SF).collect()
    assert len(requests) == len(q)
    kind = {"int": int, "double": float, "text": str}
    for r in requests:
        case = q[r.id]
        payload = {"txId": case.id, "risk_level": case.risk_level, "triggered_rules": [
            {"rule_id": rid, "rule_name": C.RULE_DOCS[rid][0],
             "evidence": {f: kind[k](case[f]) for f, k in C.EVIDENCE_FIELDS[rid]} | {"proxy_note": C.PROXY_NOTES[rid]},
             "limit": C.RULE_DOCS[rid][3]} for rid in C.SUPPORTED_RULE_IDS if case[f"{rid}_hit"]], "missing_info": list(C.UNAVAILABLE_FIELDS)}
        assert r.user == C.DRAFT_USER_PREFIX + json.dumps(payload)


def test_own_rules_and_weights(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 5.0), (3, "c", None), (4, None, 9.0), (5, "a", 1.0)], "id long, primary_segment string, x double")
    rules = spark.createDataFrame([("z9", "x > 4"), ("a1", "x > 8 OR id = 1"), ("m", "x IS NULL")], "rule_id string, predicate string")
    weights = spark.createDataFrame([("a", "z9", 70), ("a", "a1", 25), ("a", "a1", 10), ("b", "a1", 5), ("c", "m", None)],
                                    "primary_segment string, rule_id string, weight int")
    got = {r.id: r for r in R.score_rule_table(df, rules, weights).collect()}
    assert [tuple(x) for x in got[1].rule_hits] == [("a1", 35), ("z9", 70)]
    assert (got[1].risk_score_raw, got[1].risk_score, got[1].risk_level) == (105, 100, "Critical")
    assert [tuple(x) for x in got[2].rule_hits] == [("z9", 0)] and got[2].risk_score == 0
    assert [tuple(x) for x in got[3].rule_hits] == [("m", 0)] and [tuple(x) for x in got[4].rule_hits] == [("a1", 0), ("z9", 0)]
    assert got[5].rule_hits == [] and got[5].risk_level == "Low"
    with pytest.raises(ValueError):
        R.score_rule_table(df, rules.union(rules), weights)
    assert {r.risk_score for r in R.score_rule_table(df, rules.where("false"), weights).collect()} == {0}


def test_population_ranks_with_a_hot_value(spark):
    import pandas as pd

    r = random.Random(2)
    rows = [(i, 7 if i % 3 == 0 else r.randrange(50), None if i % 11 == 0 else r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a long, b double").repartition(6)
    out = CA.population_pct_ranks(df, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = {x.id: (x.pct_a, x.pct_b) for x in out.collect()}
    want = pd.DataFrame(rows, columns=["id", "a", "b"])
    for i, a, b in zip(want["id"], want["a"].rank(pct=True), want["b"].rank(pct=True)):
        assert abs(got[i][0] - a) < 1e-12 and (got[i][1] is None if b != b else abs(got[i][1] - b) < 1e-12)


def test_postings_count_like_python(spark):
    words = ["aa", "an", "ana", "banana", "na b", "é", "b"]
    texts = ["banana banana", "aaaa ana", "É nab é", "", "BANANA na b", "xyz"]
    chunks = spark.createDataFrame([(f"c{i}", i, 0, "s", 1, t) for i, t in enumerate(texts)],
                                   "chunk_id string, page long, source_rank int, source_id string, chunk_no int, text string")
    got = {(r.chunk_id, r.keyword): r.n for r in CO.postings(chunks, words).collect()}
    assert got == {(f"c{i}", w): n for i, t in enumerate(texts) for w in words if (n := t.lower().count(w))}


def test_threshold_top_k_equals_full_scoring_and_touches_few(spark):
    r = random.Random(3)
    rows = [(f"c{i:05d}", i // 3, i % 2, f"s{i % 2}", i % 3, *[max(0, int(r.expovariate(0.4)) - 1) for _ in range(5)], r.randrange(2)) for i in range(6000)]
    names = ", ".join(f"s_{x} long" for x in CO.LISTS)
    scores = materialize(spark.createDataFrame(rows, f"chunk_id string, page long, source_rank int, source_id string, chunk_no int, {names}"))
    top, touched = CO.topk_by_threshold(scores, 6, depth=16)
    got = {}
    for x in top.collect():
        got.setdefault(x.rule_mask, []).append((x.chunk_rank, x.chunk_id, x.retrieval_score))
    for mask in range(CO.N_MASKS):
        lists = [CO.LISTS.index(x) for x in CO.lists_of(mask)]
        every = sorted(((-sum(row[5 + k] for k in lists), row[1], row[2], row[3], row[4], row[0]) for row in rows if sum(row[5 + k] for k in lists)))
        assert sorted(got[mask]) == [(i + 1, x[5], -x[0]) for i, x in enumerate(every[:6])], mask
    seen = {x.rule_mask: x["count"] for x in touched.groupBy("rule_mask").count().collect()}
    assert all(n < 1500 for m, n in seen.items() if m in (1, 2, 4, 8, 16)) and max(seen.values()) < 4500


def test_threshold_top_k_of_the_tables_scores_few_chunks(spark):
    vocab = CO.keyword_vocabulary(C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS)
    chunks = CO.corpus_chunks(spark, load_corpus_pages(spark, "/root/testdata/sf0.01"))
    scores = materialize(CO.list_scores(CO.postings(chunks, vocab), C.DRIVER_RULE_KEYWORDS, C.DRIVER_DEFAULT_KEYWORDS))
    _, touched = CO.topk_by_threshold(scores)
    assert touched.count() < CO.set_scores(scores).count() / 2
    none, _ = CO.topk_by_threshold(scores.where("false"))
    assert none.collect() == []


def test_counts_come_from_the_write(spark, tmp_path):
    from riskgraph import sinks

    df = spark.range(1234).repartition(5)
    assert sinks.put_json(df, str(tmp_path / "j")) == 1234 == spark.read.json(str(tmp_path / "j")).count()
    assert sinks.put_csv(df.where("id < 0"), str(tmp_path / "c")) == 0
    drafts = spark.createDataFrame([(1, 1, "a", {"k": "v"}, '{"k":"v","n":{"x":[1,2.5,null]},"t":true}'), (2, 2, "b", None, None), (3, 3, None, {}, "{}")],
                                   "id long, txId long, risk_summary string, extra map<string,string>, extra_json string")
    assert sinks.put_drafts(drafts, str(tmp_path / "d")) == 3
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "d")).collect()), key=lambda x: x["txId"])
    assert got == [{"txId": 1, "risk_summary": "a", "k": "v", "n": {"x": [1, 2.5, None]}, "t": True}, {"txId": 2, "risk_summary": "b"},
                   {"txId": 3, "risk_summary": None}]
