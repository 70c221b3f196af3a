"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from riskgraph.session import scratch_path

_paths: dict[int, str] = {}
_frames: dict[str, tuple[DataFrame, int]] = {}  # with the thread that wrote the table


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table of its own, in folders by the columns named, read back: lineage ends there and Spark
    knows the size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return adopt((spark.read.schema(df.schema) if by else spark.read).parquet(path), path)


def adopt(frame: DataFrame, path: str) -> DataFrame:
    """Remember that ``frame`` reads the table at ``path``."""
    _paths[id(frame)] = path
    _frames[path] = frame, threading.get_ident()  # keeps the id in use
    return frame


def live() -> set[str]:
    """Tables that this thread has written and not yet discarded (another run in the driver is another thread)."""
    return {path for path, (_, owner) in _frames.items() if owner == threading.get_ident()}


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written`, once all that reads them is written itself."""
    for frame in frames:
        discard_paths(frame.sparkSession, {_paths[id(frame)]})


def discard_paths(spark: SparkSession, paths: set[str]) -> None:
    for path in paths & set(_frames):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _paths[id(_frames.pop(path)[0])]
