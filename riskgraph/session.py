"""Session helpers: building a session for tests/bench and locating the shared
scratch folder (the cluster's ``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "riskgraph",
                  extra: dict | None = None) -> SparkSession:
    """A session.  Master, shuffle partitions and memory are the cluster's unless the caller names them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system), and
    it is an error not to configure one.  Only where driver and executors are
    one process (a local master, as in tests) a fresh local folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="riskgraph-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


_tables: dict[int, tuple[object, str]] = {}


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder and
    reading it back (one job; survives executor loss; later scans prune columns).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    _tables[id(out)] = (out, path)
    return out


def discard(*frames) -> None:
    """Delete tables that ``materialize`` wrote, once everything that reads them is written itself."""
    for frame in frames:
        _, path = _tables.pop(id(frame))
        spark = frame.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


TASK_ROWS = 500_000  # of two or three numbers: what one task sorts or hashes at a time


def parts_for(spark, rows: int) -> int:
    """Partitions that keep a task at ``TASK_ROWS`` rows, however many there are (at least one per core)."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def checkpoint_keep_partitions(df):
    """Reliable checkpoint that keeps the exact partition layout (for row
    positions).  The frame is persisted first so the checkpoint write does not
    recompute it, and released afterwards."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def literal_rows(spark: SparkSession, rows, schema_ddl: str):
    """A small fixed table built JVM-side (no Python worker): an inline array of
    struct literals over a one-row range.  For configuration dimensions only."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema_ddl)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)])
        for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], st)
    return spark.range(1).select(F.inline(F.array(*structs)))
