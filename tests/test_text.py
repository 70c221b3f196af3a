from pyspark.sql import functions as F

from riskgraph.functions.text import (chunk_texts, clean_review_text, mask_id, normalise_ws, py_float_text,
                                      rule_id_dashed, rule_id_plain, substring_count)


def test_chunk_counts_by_length(spark):
    lengths = [0, 120, 121, 1200, 1201, 2240, 2241, 3000]
    expect = [0, 0, 1, 1, 2, 2, 3, 3]
    df = spark.createDataFrame([("x" * n,) for n in lengths], "t string")
    got = [r[0] for r in df.select(F.size(F.coalesce(chunk_texts(F.col("t")), F.array()))).collect()]
    assert got == expect


def test_chunk_windows_overlap(spark):
    text = "".join(chr(ord("a") + (i % 26)) for i in range(3000))
    chunks = spark.createDataFrame([(text,)], "t string").select(chunk_texts(F.col("t")).alias("c")).first().c
    assert [len(c) for c in chunks] == [1200, 1200, 920]
    assert chunks[0][-160:] == chunks[1][:160]
    assert all(121 <= len(c) <= 1200 for c in chunks)


def test_whitespace_unicode(spark):
    df = spark.createDataFrame([("  a  b c\n\td\x1ce  ",)], "t string")
    assert df.select(normalise_ws(F.col("t"))).first()[0] == "a b c d e"


def test_substring_count_non_overlapping(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("red flag, Red Flag", "red flag")], "t string, k string")
    got = [r[0] for r in df.select(substring_count(F.lower(F.col("t")), F.col("k"))).collect()]
    assert got == [2, 2]


def test_float_text_matches_python(spark):
    vals = [3000000000.0, 0.0005, 1e-05, 2.602832, 12.0, 1e16, 0.1 + 0.2, 0.0, 0.0001, 123456789.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(py_float_text(F.col("x"))).collect()] == [repr(v) for v in vals]


def test_mask_and_rule_ids(spark):
    df = spark.createDataFrame([(123456, "R001"), (7, "R005")], "id long, r string")
    rows = df.select(mask_id(F.col("id")), rule_id_dashed(F.col("r")), rule_id_plain(rule_id_dashed(F.col("r")))).collect()
    assert tuple(rows[0]) == ("12...56", "R-001", "R001")
    assert tuple(rows[1]) == ("7...7", "R-005", "R005")


def test_clean_review_text_order(spark):
    df = spark.createDataFrame([("out_degree: 3, in_degree: 1, time_step_activity: 9",)], "t string")
    assert df.select(clean_review_text(F.col("t"))).first()[0] == (
        "outbound degree: 3, inbound degree: 1, time-window activity: 9")


def test_whitespace_by_property_is_the_listed_class(spark):
    """Every character of the basic plane is white space by the fast pattern if and only if it is in the listed class."""
    from riskgraph.functions import text as X

    chars = spark.range(65536).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    odd = chars.where(F.regexp_like("c", F.lit(f"^{X.WHITESPACE_RUN}$")) != F.regexp_like("c", F.lit(f"^{X.WHITESPACE_CLASS}+$")))
    assert odd.count() == 0
    assert chars.where(F.regexp_like("c", F.lit(f"^{X.WHITESPACE_CLASS}+$"))).count() > 20


def test_scan_leaves_places_that_start_no_keyword(spark):
    """Keywords that hold signs of patterns are found as they stand, and the scan looks at first characters before whole keywords."""
    from riskgraph.operators import corpus as CO

    vocab = ["-x", "^y", "]z", "a.b", "aa", "\\d", "&&", "the", "then", " q", "\u00e9t\u00e9"]
    assert CO.scan_pattern(vocab).startswith("(?=[") and CO.scan_pattern(["then", "the"]) == "(?=[t])(?=(then|the))"
    text = "THEN the-x^y]za.b aaa axb \\d1 d &&& then q \u00c9t\u00e9 \u00e9t\u00e9s bthe"
    chunks = spark.createDataFrame([("c", 1, 0, "s", 1, text)], "chunk_id string, page long, source_rank int, source_id string, chunk_no int, text string")
    got = {r["keyword"]: r["n"] for r in CO.postings(chunks, vocab).collect()}
    assert got == {k: text.lower().count(k) for k in vocab if text.lower().count(k)}
