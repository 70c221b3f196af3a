import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskgraph.llm import line_rules, queries

from .helpers import SF, awkward_docs, no_docs, rows

SPACE = r"[\x20\x09-\x0D]+"


def base(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed)


def norm(line):
    return re.sub("[1-9]", "0", re.sub(SPACE, " ", line.lower())).strip(" ")


def judged(docs, min_texts, max_share):
    """doc_id -> kept, from all (doc_id, host, text)."""
    lines, hosts = defaultdict(set), defaultdict(set)
    for _, host, text in docs:
        hosts[host].add(text or "")
        for x in (text or "").split("\n"):
            if re.sub(SPACE, "", x):
                lines[host, norm(x)].add(text or "")
    often = {k for k, v in lines.items() if len(v) > min_texts and len(v) > max_share * len(hosts[k[0]])}
    out = []
    for i, host, text in docs:
        gone = sum(len(re.sub(SPACE, "", x)) for x in (text or "").split("\n") if re.sub(SPACE, "", x) and (host, norm(x)) in often)
        b = base(text)
        out.append((i, *b, not b[5] and gone <= 0.5 * b[1]))
    return sorted(out, key=repr)


def test_query_matches_brute_force(spark):
    got = sorted((tuple(r)[:8] for r in queries.op4_line_rules(spark, SF).collect()), key=repr)
    assert got == judged(rows("documents", "doc_id, source, text"), 10, 0)


@pytest.fixture(scope="module")
def boiler():
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(k, "h", f"Cookies  ARE good {k % 10} for all of you here today\nown{chr(97 + k)} {body}") for k in range(12)]
    docs += [(20 + k, "h", f"Cookies are good 5 for all of you here today\n{' '.join(f'{k}x{i}' for i in range(3))}") for k in range(3)]
    docs += [(30, "other", "Cookies are good 3 for all of you here today\n" + body), (31, None, None), (31, None, None)]
    docs += [(40 + k, "h", "copied line one two three\n" + " ".join(f"q{i}" for i in range(55))) for k in range(30)]
    return docs


def test_boilerplate_and_copies(spark, boiler):
    table = spark.createDataFrame(boiler, "doc_id long, source string, text string")
    got = line_rules.judge(table, min_texts=5, max_share=0.1, min_words=5).collect()
    flags = {r["doc_id"]: (r["kept"], r["removed_chars"]) for r in got}
    assert len(got) == len(boiler)
    assert flags[0][0] and flags[0][1] > 0, "a removed line alone does not deplete a long document"
    assert not flags[20][0], "what is left is less than half"
    assert flags[30] == (True, 0), "lines count per host"
    assert flags[45] == (True, 0), "copies are one text"
    wide = line_rules.judge(table, min_texts=5, max_share=0.1).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                                      "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, wide), key=repr) == judged(boiler, 5, 0.1)


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = sorted((tuple(r)[:8] for r in line_rules.judge(docs).collect()), key=repr)
    assert got == judged([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], 10, 0)
    assert line_rules.judge(no_docs(spark)).collect() == []


def test_hot_host_is_judged_as_a_small_one(spark):
    body = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.conv("id", 10, 26)) for i in range(5)])
    line = F.lit("read all of the terms and conditions here now ")
    held = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.concat(line, F.lit("\n"), body).alias("text"))
    rest = spark.range(100, 12100).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), body.alias("text"))
    for table in (held, held.union(rest)):
        got = line_rules.judge(table, min_words=5).where("doc_id < 12").collect()
        assert len(got) == 12 and all(r["removed_chars"] == 37 and not r["kept"] for r in got)


def test_large_host_through_sql(spark, tmp_path):
    """A line in 12 of 12,000 texts of one host is boilerplate in the query and in its SQL alike."""
    import duckdb

    docs = spark.range(12000).selectExpr(
        "id doc_id", "concat(case when id < 12 then 'the same notice on some pages of this host\n' else '' end, 'own', id, ' ', "
        "concat_ws(' ', transform(sequence(0, 59), k -> concat('w', k, 'x', id % 50)))) text", "'en' lang", "'h' source", "1L n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op4_line_rules(spark, str(tmp_path)).select("doc_id", "kept", "removed_chars").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(f"SELECT doc_id, kept, removed_chars FROM ({queries.oracle_sql()['op4_line_rules']}) t").fetchall())
    assert {i for i, _, n in got if n} == set(range(12))


def test_large_host_of_lettered_lines_through_sql(spark, tmp_path):
    """As above, with own lines that differ by letters: digits are counted as 0, so lines that differ by digits alone are one line."""
    import duckdb

    docs = spark.range(12000).selectExpr(
        "id doc_id", "concat(case when id < 12 then 'the same notice on some pages of this host\n' else '' end, "
        "'own', translate(id, '0123456789', 'abcdefghij'), ' ', concat_ws(' ', transform(sequence(0, 59), k -> concat('w', k, 'x', id % 50)))) text",
        "'en' lang", "'h' source", "1L n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op4_line_rules(spark, str(tmp_path)).select("doc_id", "kept", "removed_chars").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(f"SELECT doc_id, kept, removed_chars FROM ({queries.oracle_sql()['op4_line_rules']}) t").fetchall())
    assert {i for i, _, n in got if n} == set(range(12))
