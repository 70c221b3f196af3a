"""Queries of the operators in this package over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import ann, byte_bpe, duck, html_extract, jaccard_join, line_rules, packing, quality_eb, repeat_dedup, secret_scan, setsketch_dedup, spelling_groups, url_filters, whitening

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``; a page's label is that of the document its path names (quality 0 or toxic 1: bad)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = pages.select("url", F.regexp_extract("url", r"://[^/?#]*/[^?#]*?([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|\z)", 1)
                         .try_cast("long").alias("doc_id"))
    labelled = named.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filters.judge(pages, labelled, URL_RULES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return secret_scan.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))


def op3_quality_eb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; host is its source, path its language section."""
    docs = table(spark, sf_dir, "documents")
    return quality_eb.classify(docs, good_labels(spark, sf_dir), F.col("source"), F.col("lang"), carry=["doc_id", "source", "lang"])


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.groups(table(spark, sf_dir, "documents"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_eb": op3_quality_eb,
    "op4_line_rules": op4_line_rules,
    "op5_packing": op5_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_repeat_dedup": op7_repeat_dedup,
    "op8_ann": op8_ann,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_html_extract": op10_html_extract,
    "op11_whitening": op11_whitening,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_setsketch_dedup": op13_setsketch_dedup,
}


def oracle_sql() -> dict[str, str]:
    return dict(duck.ORACLES)
