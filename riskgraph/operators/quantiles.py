"""Exact percentiles with linear interpolation (pandas ``quantile`` semantics).

The method follows the metric's type, never the size of the input:

integer metrics
    Spark's ``percentile`` aggregate, all of them in one grouped pass.  Its
    buffer is a map value -> count per group.  The integer metrics here are
    counts (degrees, nodes per step): k distinct non-negative counts summing
    to T need T >= k(k-1)/2, so the map has at most about sqrt(2T) entries
    and stays small at any scale.

other metrics (ratios, intensities: as many values as rows)
    Distributed selection (``at_ranks``).  Rows are counted per distinct value
    (a hot value becomes one row on the map side), the distinct values are
    range-partitioned and sorted, and counts per partition turn a rank into a
    place in one partition.  No step holds more than one partition.

Interpolation follows Spark's ``percentile``: position = (n - 1) * p,
value = (ceil - pos) * v[floor] + (pos - floor) * v[ceil].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from riskgraph.session import materialize


def _interpolate(pos, lo, hi, v_lo, v_hi):
    return (
        F.when(lo == hi, v_lo)
        .when(v_lo == v_hi, v_lo)
        .otherwise((hi.cast("double") - pos) * v_lo + (pos - lo.cast("double")) * v_hi)
    )


def sorted_counts(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(keys..., value, c, _pid, start) of the distinct values in order, where ``start`` counts the rows
    of the same key before the value, and (keys..., n) with the rows of each key.

    The sorted values are written with the number of their partition; only the
    counts per (partition, key) are brought together, at most one row per partition
    and key that meet.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    order = [F.col(k) for k in (*keys, value)]
    part = materialize(counts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(
        "_pid", F.spark_partition_id()), "sorted_counts")
    sizes = part.groupBy("_pid", *keys).agg(F.sum("c").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = part.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, ["_pid", *keys]).select(
        *keys, value, "c", (F.col("_off") + F.col("_in")).alias("start"))
    return rows, sizes.groupBy(*keys).agg(F.sum("_n").alias("n"))


def value_at_rank(df: DataFrame, col: str, k: int) -> tuple:
    """(value, rows before it) at 0-based rank ``k`` of ``col`` (nulls skipped), exactly; None beyond the end."""
    rows, _ = sorted_counts(df.where(F.col(col).isNotNull()).select(col), [], col)
    hit = rows.where((F.col("start") <= F.lit(k)) & (F.lit(k) < F.col("start") + F.col("c"))).select(col, "start").first()
    return None if hit is None else tuple(hit)


def _at_ranks(df: DataFrame, metrics: Sequence[str], probs: Sequence[float], group_cols: Sequence[str]) -> DataFrame:
    keys = [*group_cols, "metric"]
    long = (
        df.select(*group_cols, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(list(group_cols), list(metrics), "metric", "value")
        .where(F.col("value").isNotNull())
    )
    rows, sizes = sorted_counts(long, keys, "value")
    pos = lambda p: (F.col("n") - 1).cast("double") * F.lit(float(p))
    targets = sizes.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), pos(p).alias("pos"), F.floor(pos(p)).cast("long").alias("lo"), F.ceil(pos(p)).cast("long").alias("hi"))
        for p in probs])))
    # one row per key and probability: the planner broadcasts it after checking its size
    met = rows.join(targets, keys)
    at = lambda r: (F.col("start") <= F.col(r)) & (F.col(r) < F.col("start") + F.col("c"))
    found = met.where(at("lo") | at("hi")).groupBy(*keys, "p", "pos", "lo", "hi").agg(
        F.max(F.when(at("lo"), F.col("value"))).alias("v_lo"), F.max(F.when(at("hi"), F.col("value"))).alias("v_hi"))
    return found.select(*keys, "p", _interpolate(F.col("pos"), F.col("lo"), F.col("hi"), F.col("v_lo"), F.col("v_hi")).alias("quantile"))


def _percentiles(df: DataFrame, metrics: Sequence[str], probs: Sequence[float], group_cols: Sequence[str]) -> DataFrame:
    asked = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*group_cols).agg(*[F.percentile(F.col(m).cast("double"), asked).alias(m) for m in metrics])
    long = wide.unpivot(list(group_cols), list(metrics), "metric", "q").where(F.col("q").isNotNull())
    return long.select(*group_cols, "metric", F.posexplode("q").alias("i", "quantile")).select(
        *group_cols, "metric", asked[F.col("i")].alias("p"), "quantile")


def quantile_long(df: DataFrame, metrics: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """Long table: group_cols..., metric, p, quantile (one row per group, metric, p).

    Groups or metrics without any non-null value produce no row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = [m for m in metrics if isinstance(types[m], IntegralType)]
    other = [m for m in metrics if m not in whole]
    parts = [f(df, ms, probs, group_cols) for f, ms in ((_percentiles, whole), (_at_ranks, other)) if ms]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quantile_wide(df: DataFrame, metrics: Sequence[str], probs: Sequence[float],
                  group_cols: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """One row per group with columns ``<prefix><metric>_pNN``."""
    from riskgraph.config import prob_label

    long = quantile_long(df, metrics, probs, group_cols)
    names = {(m, float(p)): f"{prefix}{m}_{prob_label(p)}" for m in metrics for p in probs}
    aggs = [
        F.max(F.when((F.col("metric") == m) & (F.col("p") == F.lit(float(p))), F.col("quantile"))).alias(name)
        for (m, p), name in names.items()
    ]
    if group_cols:
        return long.groupBy(*group_cols).agg(*aggs)
    return long.agg(*aggs)
