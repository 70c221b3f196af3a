"""File sources: input discovery and the three CSV inputs (labels, edges,
wide node features), plus JSON read-back of exported records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import config as C
from riskgraph.functions.labels import decode_class

INPUT_NAMES = C.INPUT_FILE_NAMES


def discover(spark: SparkSession, root: str, names: dict[str, str] | None = None) -> DataFrame:
    """(key, path) for every input found by exact name anywhere under root.

    An input is a file or a folder of part files with the expected name; of
    several with one name the path that sorts first counts.  Only paths are read,
    no file content; the file source keeps the listing of the tree on the driver.
    """
    import re

    names = names or INPUT_NAMES
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(F.col("path"))
    )
    found = None
    for key, name in names.items():
        pat = r"^(.*/" + re.escape(name) + r")(/.*)?$"
        hit = files.where(F.col("path").rlike(pat)).select(
            F.lit(key).alias("key"), F.regexp_extract("path", pat, 1).alias("path")).groupBy("key").agg(F.min("path").alias("path"))
        found = hit if found is None else found.unionByName(hit)
    return found


LABEL_SCHEMA = T.StructType([T.StructField("txId", T.StringType()), T.StructField("class", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField("txId1", T.StringType()), T.StructField("txId2", T.StringType())])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV (txId, class); class kept as text and decoded."""
    raw = spark.read.option("header", "true").schema(LABEL_SCHEMA).csv(path)
    return raw.select(F.col("txId").cast("long").alias("id"), F.col("class").alias("class_raw")).withColumn(
        "label_name", decode_class(F.col("class_raw")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """S3: header CSV (txId1, txId2) -> (src, dst); rows with a missing end dropped."""
    raw = spark.read.option("header", "true").schema(EDGE_SCHEMA).csv(path)
    return raw.select(F.col("txId1").cast("long").alias("src"), F.col("txId2").cast("long").alias("dst")).dropna()


def feature_schema(n_features: int) -> T.StructType:
    fields = [T.StructField("id", T.LongType()), T.StructField("time_step", T.DoubleType())]
    fields += [T.StructField(f"f_{i:03d}", T.DoubleType()) for i in range(1, n_features + 1)]
    return T.StructType(fields)


def read_nodes(spark: SparkSession, path: str, n_features: int = 165) -> DataFrame:
    """Headerless wide CSV read with one explicit schema (id, time_step, f_001..)."""
    return spark.read.option("header", "false").schema(feature_schema(n_features)).csv(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines records read back with a declared schema."""
    return spark.read.schema(schema).json(path)
