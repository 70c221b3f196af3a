"""Next row within a group in a total order (``lead``) without holding a hot
group in one task.

Groups with more rows than an even share of the partitions are found exactly
(``hot_groups``); there are at most as many as partitions, and mostly none.
Without any, the rows take one plain window and are not written.  Else they are
written once; groups that are not hot take the window, and the rows of hot ones
are range-partitioned and sorted on (group, order...), so a hot
group spreads over many partitions; ``lead`` runs per (partition, group), and the
last row of each (partition, group) takes the first row of the same group in
the next partition that has one.  That step works on a table with one row per
(partition, group), whose per-group size is at most the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.session import materialize


def hot_groups(rows: DataFrame, group: str, n: int) -> list:
    """Groups (NULL among them) of more than an n-th of the ``rows``: at most n values.

    ``freqItems`` names every such group and perhaps others; these candidates are then counted exactly.
    """
    share = rows.count() // n
    named = rows.where(F.col(group).isNotNull()).stat.freqItems([group], max(1e-4, 1 / (n + 1))).first()[0] or []
    g = F.col(group)
    counts = rows.where(g.isNull() | g.isin(named)).groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > share).collect()]


def lead_within(df: DataFrame, group: str, order: Sequence[str], value: str, out: str = "next_value",
                num_partitions: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``out`` = ``value`` of the next row of the same ``group`` in ``order`` (NULL for the last).

    ``counted``: a cheap frame with (about) the groups of ``df``, row for row; if no group is hot there, the rows
    themselves are neither written nor counted.  Only the way depends on it, not the result.

    ``order`` must make rows of a group totally ordered up to ties whose
    ``value`` is equal (then any tie order gives the same result).
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(group).orderBy(*order)
    if counted is not None and not hot_groups(counted, group, n):
        return df.withColumn(out, F.lead(value).over(w))
    rows = materialize(df, "lead_rows")
    hot = hot_groups(rows, group, n)
    if not hot:
        return rows.withColumn(out, F.lead(value).over(w))
    is_hot = F.coalesce(F.col(group).isin([h for h in hot if h is not None]), F.lit(None in hot))
    cold = rows.where(~is_hot).withColumn(out, F.lead(value).over(w))
    return cold.unionByName(_lead_across(rows.where(is_hot), group, order, value, out, n))


def _lead_across(df: DataFrame, group: str, order: Sequence[str], value: str, out: str, n: int) -> DataFrame:
    """``lead_within`` of groups that span partitions.  Place in the sorted partition is written with the rows."""
    keys: list[Column] = [F.col(group)] + [F.col(c) for c in order]
    part = materialize(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()), "lead_sorted")
    # lead inside each (partition, group): groups are bounded by the partition size
    w = Window.partitionBy("_pid", group).orderBy("_pos")
    local = part.withColumn(out, F.lead(value).over(w)).withColumn("_last", F.lead("_pos").over(w).isNull())
    # first row of each (partition, group); then the next partition's first row per group
    firsts = part.groupBy("_pid", group).agg(F.min_by(F.col(value), F.col("_pos")).alias("_first"))
    wn = Window.partitionBy(group).orderBy("_pid")
    nxt = firsts.select(F.col("_pid").alias("_p"), F.col(group).alias("_g"), F.lead("_first").over(wn).alias("_next_first"))
    fixed = local.join(nxt, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(
        out, F.when(F.col("_last"), F.col("_next_first")).otherwise(F.col(out)))
    return fixed.drop("_pid", "_pos", "_last", "_p", "_g", "_next_first")
