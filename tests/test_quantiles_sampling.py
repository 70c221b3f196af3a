import random

from pyspark.sql import functions as F

from riskgraph.operators import quantiles as Q
from riskgraph.operators import sampling as S


def _skewed(spark, n=20000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else "cold"
        v = 5.0 if (g == "hot" and i % 2) else rnd.random() * 100  # a hot value holding a third of the rows
        rows.append((i, g, v, rnd.randint(0, 30), None if i % 97 == 0 else rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, g string, v double, k long, z double")


def test_selection_equals_percentile(spark):
    df = _skewed(spark)
    probs = [0.0, 0.1, 0.37, 0.5, 0.75, 0.9, 0.95, 1.0]
    for groups in ([], ["g"]):
        rows = lambda f: {(tuple(r[c] for c in groups), r.metric, r.p): r.quantile
                          for r in f(df, ["v", "k", "z"], probs, groups).collect()}
        assert rows(Q._at_ranks) == rows(Q._percentiles) == rows(Q.quantile_long)  # bitwise equal


def test_no_values_no_rows(spark):
    df = _skewed(spark, n=50).withColumn("z", F.when(F.col("g") == "hot", F.lit(None).cast("double")).otherwise(F.col("z")))
    got = {(r.g, r.metric) for r in Q.quantile_long(df, ["z", "k"], [0.5], ["g"]).collect()}
    assert got == {("cold", "z"), ("cold", "k"), ("hot", "k")}
    assert Q.quantile_wide(df.where("false"), ["z"], [0.5]).first()[0] is None


def test_value_at_rank(spark):
    df = _skewed(spark, n=5000)
    values = sorted(r.v for r in df.select("v").collect())
    for k in (0, 1, 1234, 4999):
        assert Q.value_at_rank(df, "v", k) == (values[k], values.index(values[k]))
    assert Q.value_at_rank(df, "v", 5000) is None


def test_ranked_slice_is_the_sorted_slice(spark):
    df = _skewed(spark, n=5000).withColumn("risk_score", (F.col("k") * 3).cast("int"))
    ref = [r.id for r in df.orderBy(F.col("risk_score").desc(), "id").collect()]
    for skip, take in ((1200, 300), (0, 10), (4990, 300), (5000, 5)):
        assert [r.id for r in S.ranked_slice(df, skip, take).collect()] == ref[skip:skip + take]


def test_global_rank(spark):
    df = _skewed(spark, n=4000).withColumn("risk_score", (F.col("k") * 3).cast("int"))
    ranked = {r.id: r.rank for r in S.global_rank(df, S.rank_order(), num_partitions=5).collect()}
    ref = [r.id for r in df.orderBy(F.col("risk_score").desc(), "id").collect()]
    assert [ranked[i] for i in ref] == list(range(1, len(ref) + 1))


def test_top_per_group_is_exact(spark):
    df = _skewed(spark, n=6000)
    order = [S.draw_key(42), F.col("id")]
    got = {(r.g, r.id) for r in S.top_per_group(df, ["g"], order, 25, salts=16, salt_key=F.col("id")).collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy(*order)
    ref = {(r.g, r.id) for r in df.withColumn("rn", F.row_number().over(w)).where("rn <= 25").collect()}
    assert got == ref


def test_lead_within_equals_window(spark):
    from pyspark.sql import Window

    from riskgraph.operators.sequence import lead_within

    rnd = random.Random(3)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), rnd.randint(0, 40), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g long, d long, k long")
    w = Window.partitionBy("g").orderBy("d", "k")
    ref = sorted(tuple(r) for r in df.withColumn("nx", F.lead("k").over(w)).collect())
    for parts in (None, 7):
        assert sorted(tuple(r) for r in lead_within(df, "g", ["d", "k"], "k", "nx", num_partitions=parts).collect()) == ref


def test_lead_within_hot_groups(spark):
    """Only groups above an even share are sorted over partitions (the NULL group, too); the rest is one window, nothing is persisted."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskgraph.operators.sequence import hot_groups, lead_within
    from riskgraph.session import materialize

    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 5 = 0 then null else id end as g", "id as k")
    assert [set(hot_groups(materialize(df), "g", n)) for n in (1, 4, 8)] == [set(), {7}, {7, None}]
    ref = sorted(map(str, df.withColumn("nx", F.lead("k").over(Window.partitionBy("g").orderBy("k"))).collect()))
    for n in (1, 4, 8):
        assert sorted(map(str, lead_within(df, "g", ["k"], "k", "nx", num_partitions=n).collect())) == ref
