import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as Q

import corpus_pipeline
from riskgraph.llm import secret_scan

from .helpers import DOC_SCHEMA, awkward_docs
from .test_jaccard_join import classes
from .test_packing import check
from .test_repeat_dedup import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents, and what every stage returned, written and read again."""
    where = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(where / name))
        out.append(spark.read.parquet(str(where / name)))
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "pack"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[1:-1])


def test_quality(steps):
    before, after = texts(steps[0]), texts(steps[1])
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert np.mean([i in after for i, q in labels.items() if q == 1]) > 0.99 and np.mean([i in after for i, q in labels.items() if q == 0]) < 0.05
    assert after.items() <= before.items()


def test_near_duplicates(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert sorted(after) == sorted({c for _, c, _ in classes(list(before.items()))})


def test_repeats(steps):
    before, after = texts(steps[2]), texts(steps[3])
    want = {i: (n - gone, sha) for i, n, gone, _, sha in brute(list(before.items()))}
    assert set(before) - set(after) <= {i for i, (left, _) in want.items() if left < 200}
    assert all(after[i] == before[i] for i in after if want[i][0] == len(before[i].encode()))
    assert all(0 <= want[i][0] - len(after[i].encode()) <= 16 for i in after)
    assert sum(after[i] != before[i] for i in after) > 5


def test_secrets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert sorted(before) == sorted(after)
    for i, t in before.items():
        assert after[i] == secret_scan.masked(t, secret_scan.find(t))
    assert any(secret_scan.MASK in t for t in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_packing(steps):
    check(steps[5].collect(), list(texts(steps[4]).items()), 2048)


def test_awkward_rows(spark):
    docs = awkward_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", "kept")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        from riskgraph.llm.tables import written

        docs = written(stage(spark, docs, SF), "test_stage")
        sizes.append(docs.count())
    assert sizes[0] <= 17 and sizes[1] <= sizes[0] and sizes[4] >= sizes[3] == sizes[2]
    empty = spark.createDataFrame([], DOC_SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF), "test_stage")
        assert empty.count() == 0


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"plain{i} words" for i in range(60))
    docs = spark.createDataFrame([(4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text + " end", "en", "s", 1), (None, text, "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [4]


def test_clashing_columns_are_carried(spark):
    names = ["n_removed", "spans", "kept_text", "kept", "score", "evidence", "n_bytes", "row", "host", "section", "n_links", "class_id", "label", "number"]
    docs = spark.createDataFrame([(i, f"text {i} " + " ".join(f"plain{i}x{k} words" for k in range(60)), "en", "s", 1) for i in range(6)],
                                 "doc_id long, text string, lang string, source string, n_chars long").select(
        "*", *[Q.concat(Q.lit(n), Q.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from riskgraph.llm.tables import written

        docs = written(stage(spark, docs, SF), "test_stage")
        got = docs.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert corpus_pipeline.pack(spark, docs, SF).count() == len(got)
