"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

1. quality: documents that the hierarchical quality classifier rejects go.
2. near_duplicates: of every class of near copies the document with the smallest id stays.
3. repeats: byte strings of 200 that occur elsewhere are cut out of the texts; documents left without words go.
4. secrets: found secrets are masked in the texts; no document goes.
5. packing: the tokenised documents are packed into sequences of 2048 ids.

All but the last return the columns of documents (text and n_chars as changed).  Null ids and texts,
repeated rows, very long texts and empty tables pass through as each operator defines; a class whose ids are all null keeps
one document per different text.  Extra columns are carried whatever their names, also those of an operator's outputs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import jaccard_join, packing, quality_eb, repeat_dedup, secret_scan, tables
from riskgraph.llm.queries import good_labels

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    nested = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("section"))
    judged = quality_eb.classify(nested, good_labels(spark, sf_dir), F.col("host"), F.col("section"), carry=["row"])
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard_join.join(docs)
    stays = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.coalesce("doc_id", F.lit(jaccard_join.NO_ID)).alias("__id"), F.col("text_key").alias("__key")).distinct()
    stays = tables.written(stays, "stays")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard_join.NO_ID)),
                              "__key": F.upper(F.md5(F.coalesce("text", F.lit(""))))})
    return keyed.join(stays, ["__id", "__key"]).dropDuplicates(["__id", "__key"]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = repeat_dedup.cut(docs, carry=others, with_text=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


_run = threading.local()  # each run is a thread: tables that its last stages have left


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes what the stage before the last has left in the shared folder."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _run.__dict__.setdefault("left", [])
        if len(left) > 1:
            tables.discard_paths(spark, left.pop(0))
        before = tables.live()
        out = stage(spark, docs, sf_dir)
        left.append(tables.live() - before)
        return out

    return run


STAGES: list[tuple[str, Stage]] = [
    (f.__name__, _tidy(f)) for f in (quality, near_duplicates, repeats, secrets, pack)]

#: The fitted classifier, byte-level suffix comparison and packing have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.written(docs, f"stage_{name}")
    return docs
