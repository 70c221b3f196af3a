"""Ranking and reproducible sampling.

The ranking order is (risk_score desc, id asc): a total order, so every result
is independent of partitioning.  Random draws use an md5 key of
``"<seed>:<id>"`` (the same text hashes identically in Spark and in SQL
engines), never ``rand()`` or ``sample()``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph import config as C
from riskgraph.session import materialize


def draw_key(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def rank_order(score_col: str = "risk_score", id_col: str = "id") -> list[Column]:
    return [F.col(score_col).desc(), F.col(id_col).asc()]


def global_rank(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """L1: 1-based position of every row in a total order, fully distributed.

    Range-partition + sort, written with partition and record numbers; row
    positions come from per-partition counts (one small row per partition) plus
    the in-partition record number.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    sizes = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        part.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
        .withColumn(rank_col, F.col("_off") + local + 1)
        .drop("_pid", "_mid", "_off")
    )


def ranked_slice(scored: DataFrame, skip: int, take: int, score_col: str = "risk_score",
                 id_col: str = "id") -> DataFrame:
    """L2: rows at ranks [skip, skip + take) of (score desc, id asc).

    Scores are whole numbers with a cap (at most 101 values), so one grouped
    count finds the score at rank ``skip``; among the rows of that score the id
    is found by distributed selection.  Then a bounded top-k of ``take`` rows
    runs on what is left, so no task ever holds the skipped rows.
    """
    from riskgraph.operators.quantiles import value_at_rank

    s = F.col(score_col)
    up_to = Window.orderBy(s.desc())
    ends = scored.groupBy(s).agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.sum("c").over(up_to))
    at = ends.where(F.col("end") > skip).orderBy("end").select(score_col, (F.col("end") - F.col("c")).alias("before")).first()
    if at is None:
        return scored.limit(0)
    edge, before = at
    rest = scored.where(s <= F.lit(edge))
    if skip > before:
        first = value_at_rank(scored.where(s == F.lit(edge)).select(id_col), id_col, skip - before)[0]
        rest = scored.where((s < F.lit(edge)) | ((s == F.lit(edge)) & (F.col(id_col) >= F.lit(first))))
    return rest.orderBy(*rank_order(score_col, id_col)).limit(take)


def sample_pool(scored: DataFrame, skip: int = C.SKIP_TOP_N, batch: int = C.BATCH_SIZE,
                factor: int = C.POOL_FACTOR, **kw) -> DataFrame:
    return ranked_slice(scored, skip, batch * factor, **kw)


def seeded_sample(df: DataFrame, n: int, seed: int = C.SAMPLING_SEED, id_col: str = "id") -> DataFrame:
    """N rows by md5 draw key (ties broken by id)."""
    return df.orderBy(draw_key(seed, id_col), F.col(id_col)).limit(n)


def sample_cases(scored: DataFrame, skip: int = C.SKIP_TOP_N, batch: int = C.BATCH_SIZE,
                 seed: int = C.SAMPLING_SEED, **kw) -> DataFrame:
    pool = sample_pool(scored, skip, batch, **kw)
    return seeded_sample(pool, batch, seed)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  salts: int = 64, rank_col: str = "rn", salt_key: Column | None = None) -> DataFrame:
    """Exact top-k per group without holding a whole group in one task.

    Stage 1 keeps the top k of every (group, salt) sub-group, stage 2 the top
    k of the survivors (at most salts * k rows per group).
    """
    salt = F.pmod(F.xxhash64(salt_key if salt_key is not None else F.monotonically_increasing_id()), F.lit(salts))
    pre = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
    stage1 = pre.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


DRAW_HEAD = 3  # hex digits of a draw key by which draws are counted


def early_draws(df: DataFrame, strata: Sequence[str], per_stratum: int, seeds: Sequence[int], id_col: str = "id") -> DataFrame:
    """The rows of ``df`` that can be among the first ``per_stratum`` draws of their stratum with one of ``seeds``.

    One grouped count of (stratum, seed, first digits of the draw key) gives the digits up to which a stratum has
    enough rows; all rows up to them are kept, so nothing is sorted here and no draw is lost.  A NULL key comes first.
    """
    heads = [F.substring(draw_key(seed, id_col), 1, DRAW_HEAD) for seed in seeds]
    drawn = df.select(*strata, F.posexplode(F.array(*heads)).alias("_seed", "_head"))
    counts = drawn.groupBy(*strata, "_seed", "_head").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata, "_seed").orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < per_stratum)
    cuts = needed.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg(*[
        F.max(F.when(F.col("_seed") == i, F.col("_head"))).alias(f"_cut{i}") for i in range(len(heads))])
    # one row per stratum, written: the planner knows its size and df need not be shuffled for the look-up
    cuts = materialize(cuts, "draw_cuts")
    early = reduce(lambda x, y: x | y, [h.isNull() | (h <= F.col(f"_cut{i}")) for i, h in enumerate(heads)])
    same = reduce(lambda x, y: x & y, [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata], F.lit(True))
    return df.join(cuts, same).where(early).select(*df.columns)


def sample_stratified(df: DataFrame, strata: Sequence[str], per_stratum: int = C.PER_STRATUM,
                      seed: int = C.SAMPLING_SEED, id_col: str = "id") -> DataFrame:
    """Up to ``per_stratum`` rows per stratum by md5 draw order."""
    return _first_draws(early_draws(df, strata, per_stratum, [seed], id_col), strata, per_stratum, seed, id_col)


def _first_draws(df: DataFrame, strata: Sequence[str], per_stratum: int, seed: int, id_col: str) -> DataFrame:
    order = [draw_key(seed, id_col), F.col(id_col)]
    return top_per_group(df, strata, order, per_stratum, salt_key=F.col(id_col))


def sample_merged(df: DataFrame, strata: Sequence[str], seeds: Sequence[int],
                  per_stratum: int = C.PER_STRATUM, id_col: str = "id") -> DataFrame:
    """L4: union of stratified batches (one per seed), first batch wins per id."""
    df = materialize(early_draws(df, strata, per_stratum, seeds, id_col), "early_draws")
    batches = None
    for b, seed in enumerate(seeds):
        part = _first_draws(df, strata, per_stratum, seed, id_col).withColumn("batch", F.lit(b))
        batches = part if batches is None else batches.unionByName(part)
    w = Window.partitionBy(id_col).orderBy("batch")
    return batches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
