"""Graph operators over edge DataFrames: undirected adjacency, one- and
two-hop exposure to risky nodes, and weakly connected components.

Exposure is computed for a *set of source nodes*.  For a small set (the
review sample) every step is linear in the sources' neighbourhoods, and the
planner broadcasts the small side; for all nodes (``exposure_full``) the
two-hop step joins whole neighbour lists of ordinary nodes (no row per pair),
and is a union of bitmaps through hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.labels import distance_label
from riskgraph.functions.rounding import share
from riskgraph.session import discard, materialize, parts_for


def adjacency(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b) for both directions of every edge, distinct; self-loops kept once.

    Written as a union of two projections so that a semi-join on ``a`` (a set
    of sources) is pushed below the distinct into both edge scans.  An all-node
    run names ``parts`` (see :func:`riskgraph.session.parts_for`).
    """
    fwd = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    bwd = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    both = fwd.unionByName(bwd)
    return (both.repartition(parts, "a", "b") if parts else both).distinct()


def risky_nodes(nodes: DataFrame, labels: DataFrame, risky_label: str = "illicit") -> DataFrame:
    """Ids of node rows whose label is the risky one (a label row without a node row does not count)."""
    lab = labels.where(F.col("label_name") == risky_label).select("id")
    return nodes.select("id").join(lab, "id", "left_semi")


def _flag_risky(pairs: DataFrame, col: str, risky: DataFrame) -> DataFrame:
    r = risky.select(F.col("id").alias(col), F.lit(1).alias("risky"))
    return pairs.join(r, col, "left").withColumn("risky", F.coalesce(F.col("risky"), F.lit(0)))


def one_hop(sources: DataFrame, adj: DataFrame) -> DataFrame:
    """(a, b): distinct undirected neighbours b of each source a."""
    return adj.join(sources.select(F.col("id").alias("a")), "a", "left_semi")


def two_hop_pairs(sources: DataFrame, adj: DataFrame, hop1: DataFrame | None = None) -> DataFrame:
    """(a, c) with c reachable in two steps, c != a and c not a one-hop neighbour.

    The second step reads only adjacency rows of the sources' neighbours (a
    semi-join that reaches the edge scan), so a small source set never shuffles
    the whole edge table.
    """
    hop1 = hop1 if hop1 is not None else one_hop(sources, adj)
    step = adj.join(hop1.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    wedges = (
        hop1.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
        .where(F.col("a") != F.col("c"))
        .select("a", "c")
        .distinct()
    )
    return wedges.join(hop1.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")


def exposure_counts(sources: DataFrame, adj: DataFrame, risky: DataFrame) -> DataFrame:
    """Per source: n1, r1 (risky one-hop), n2, r2 (risky two-hop); only sources with neighbours.

    The pairs of each hop are written before they are used, so their size is known when the next scan of all edges
    or labels is planned: those of a few sources are broadcast, and neither edges nor labels are shuffled.
    """
    hop1 = materialize(one_hop(sources, adj), "one_hop")
    hop2 = materialize(two_hop_pairs(sources, adj, hop1), "two_hop")
    reached = hop1.select(F.col("b").alias("id")).union(hop2.select("c")).distinct()
    risky = materialize(risky.select("id").join(reached, "id", "left_semi"), "risky_ids")
    one = (
        _flag_risky(hop1, "b", risky)
        .groupBy("a")
        .agg(F.count(F.lit(1)).alias("n1"), F.sum("risky").cast("long").alias("r1"))
    )
    two = (
        _flag_risky(hop2, "c", risky)
        .groupBy("a")
        .agg(F.count(F.lit(1)).alias("n2"), F.sum("risky").cast("long").alias("r2"))
    )
    return one.join(two, "a", "left")


def exposure(sources: DataFrame, adj: DataFrame, risky: DataFrame, hub_limit: int | None = None) -> DataFrame:
    """J7 columns for every source id (no neighbours -> zeros, "Not observed").

    For a few sources (the review sample) the two-hop pairs are enumerated,
    which is linear in the sources' neighbourhoods.  An all-node run names
    ``hub_limit`` (see :func:`hub_degree`) and unites what is reached through
    nodes with more neighbours as bitmaps (``exposure_counts_all``).  The risky
    ids are written first (for a few sources those that were reached), so that
    the joins that look them up are plain shuffles whose hot keys Spark can split.
    """
    if hub_limit is None:
        counts = exposure_counts(sources, adj, risky)
    else:
        counts = exposure_counts_all(adj, materialize(risky.select("id"), "risky_ids"), hub_limit)
    counts = counts.withColumnRenamed("a", "id")
    df = sources.select("id").join(counts, "id", "left")
    n1, r1, n2, r2 = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n1", "r1", "n2", "r2"))
    return df.select(
        "id",
        n1.alias("one_hop_neighbor_count"),
        r1.alias("one_hop_risky_count"),
        share(r1, n1).alias("one_hop_risk_neighbor_share"),
        n2.alias("two_hop_neighbor_count"),
        r2.alias("two_hop_risky_count"),
        share(r2, n2).alias("two_hop_risk_neighbor_share"),
        distance_label(r1, r2).alias("distance_to_known_illicit_cluster"),
    )


def one_hop_exposure(sources: DataFrame, adj: DataFrame, risky: DataFrame, parts: int | None = None) -> DataFrame:
    """The one-hop columns alone: one look-up of the risky ids and one grouped count.

    With ``parts`` the rows are dealt by (a, b) before they are counted, so that each task pre-counts its share of
    every node, hubs too, in a small table."""
    flagged = _flag_risky(adj, "b", risky)
    counts = (flagged.repartition(parts, "a", "b") if parts else flagged).groupBy("a").agg(
        F.count(F.lit(1)).alias("n1"), F.sum("risky").cast("long").alias("r1"))
    df = sources.select("id").join(counts.withColumnRenamed("a", "id"), "id", "left")
    n1, r1 = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n1", "r1"))
    return df.select("id", n1.alias("one_hop_neighbor_count"), r1.alias("one_hop_risky_count"),
                     share(r1, n1).alias("one_hop_risk_neighbor_share"))


LIST = 512  # neighbours of a node that stand in one row, at most
BITMAP_BYTES = 4096  # of Spark's bitmap functions: 32,768 nodes a bitmap


def hub_degree(nodes: int) -> int:
    """Neighbours above which a node's pairs cost more than whole bitmaps (``LIST`` is the most that is used).

    A node with d neighbours has d * d pairs of two longs; as a hub it brings each of its d neighbours (if none share
    their hubs) two bitmaps per 32,768 nodes of the graph.  Results are the same either way.
    """
    buckets = -(-max(nodes, 1) // (8 * BITMAP_BYTES))
    return 2 * BITMAP_BYTES * buckets // 16


def numbered(ids: DataFrame) -> DataFrame:
    """(id, num): dense numbers from 1, in no particular order.  Places within partitions are written with the ids, so
    only one row per partition is brought together."""
    part = materialize(ids.select("id", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")), "numbered")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    place = F.col("mid") - F.shiftleft(F.col("pid").cast("long"), 33)
    return part.join(offsets, "pid").select("id", (F.col("off") + place + 1).alias("num"))


def _set_name(members: str) -> list:
    """Name of a set of ids: two independent exclusive-or sums of hashes, and the size."""
    return [F.bit_xor(F.xxhash64(members)).alias("s1"), F.bit_xor(F.xxhash64(members, F.lit("set"))).alias("s2"),
            F.count(F.lit(1)).alias("s3")]


SET = ["s1", "s2", "s3"]


WORD = 64  # bits of a bitmap that stand in one long; words without a bit are left out


def _words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, word, bits, risky_bits): bitmaps of ``num`` per key, a long per word that has a bit."""
    pos = F.bitmap_bit_position("num")
    bit = F.expr(f"shiftleft(1L, cast(bitmap_bit_position(num) % {WORD} as int))")
    return rows.groupBy(*keys, F.bitmap_bucket_number("num").alias("bucket"), F.floor(pos / WORD).cast("short").alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.bit_or(F.when(F.col("rb") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("risky_bits"))


def hub_unions(adj: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is reached through hubs, as bitmaps over dense node numbers.

    Returns (a, set) of every node next to a hub, where the set names its hubs; (set, bucket, words), the union of the
    neighbourhoods of the set's hubs, one row per set and bucket of 32,768 nodes that is not empty, with the words
    (word, bits, risky_bits) that have a bit; and (id, num).  Hub sets are named by hashes and kept as (set, hub) rows;
    inputs of every join are written, so Spark can split a hub that very many sets hold.  No pair of nodes or of sets
    is made, and a hub costs a long per word of its neighbours, however many nodes the graph has.
    """
    nums = materialize(numbered(adj.select(F.col("a").alias("id")).distinct()), "node_numbers")
    beside = adj.join(hubs.withColumnRenamed("hub", "a"), "a", "left_semi").select(F.col("a").alias("hub"), F.col("b").alias("id"), "rb")
    bitmaps = materialize(_words(beside.join(nums, "id"), ["hub"]), "hub_bitmaps")
    sets = materialize(beside.groupBy(F.col("id").alias("a")).agg(*_set_name("hub")), "hub_sets")
    members = materialize(beside.select(F.col("id").alias("a"), "hub").join(sets, "a").select(*SET, "hub").distinct(), "hub_set_members")
    united = members.join(bitmaps, "hub").groupBy(*SET, "bucket", "word").agg(
        F.bit_or("bits").alias("bits"), F.bit_or("risky_bits").alias("risky_bits"))
    unions = materialize(united.groupBy(*SET, "bucket").agg(F.collect_list(F.struct("word", "bits", "risky_bits")).alias("words")), "hub_unions")
    return sets, unions, nums


def _lists(adj: DataFrame, kind: str, parts: int) -> DataFrame:
    """(id, cs, rs): a node's neighbours and the risky ones among them, as ids of type ``kind``."""
    b = F.col("b").cast(kind)
    return adj.repartition(parts, "a").groupBy("a").agg(
        F.collect_list(b).alias("cs"), F.collect_list(F.when(F.col("rb") == 1, b)).alias("rs")).withColumnRenamed("a", "id")


def _reached(light: DataFrame, lists: DataFrame, kind: str, parts: int) -> DataFrame:
    """(a, cs, rs): the distinct nodes without a that are a's neighbours or neighbours of b for a row (a, b) of
    ``light``, and the risky ones among them.  Neighbour lists travel whole, not as rows per pair."""
    steps = light.join(lists.withColumnRenamed("id", "b"), "b").select("a", "cs", "rs").unionByName(
        lists.withColumnRenamed("id", "a"))
    all_of = steps.repartition(parts, "a").groupBy("a").agg(
        F.flatten(F.collect_list("cs")).alias("cs"), F.flatten(F.collect_list("rs")).alias("rs"))
    return all_of.select("a", *[F.array_remove(F.array_distinct(c), F.col("a").cast(kind)).alias(c) for c in ("cs", "rs")])


def exposure_counts_all(adj: DataFrame, risky: DataFrame, hub_limit: int) -> DataFrame:
    """(a, n1, r1, n2, r2) like ``exposure_counts``, for every node that has neighbours.

    The two-hop set of a is T(a) minus a minus N(a), T(a) being the union of N(b) over a's neighbours b.  E(a) holds
    N(a) and what is reached through neighbours of at most ``hub_limit`` neighbours (or ``LIST``, if that is less),
    without a; U(a) is what is reached through hubs (:func:`hub_unions`), a among it.  Then
    n2 = |E| - |N without a| + |U| - 1 - |E and U|, where the last three stand only for nodes next to a hub.

    A node of at most ``LIST`` neighbours unites their lists, at most ``LIST`` times ``LIST`` ids; for the wider ones
    rows (a, c) are made distinct.
    """
    flag = risky.select(F.col("id").alias("b"), F.lit(1).alias("rb"))
    adj = materialize(adj.join(flag, "b", "left").select("a", "b", F.coalesce("rb", F.lit(0)).alias("rb")), "adjacency")
    parts = parts_for(adj.sparkSession, adj.count())
    others = F.col("a") != F.col("b")
    one = materialize(adj.repartition(parts, "a", "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n1"), F.sum("rb").cast("long").alias("r1"),
        F.count_if(others).alias("o1"), F.sum(F.when(others, F.col("rb")).otherwise(0)).alias("q1")), "degrees")
    hubs = materialize(one.where(F.col("n1") > min(hub_limit, LIST)).select(F.col("a").alias("hub")), "hubs")
    none = hubs.isEmpty()
    light = adj if none else adj.join(hubs.withColumnRenamed("hub", "b"), "b", "left_anti")
    wide = materialize(one.where(F.col("n1") > LIST).select("a"), "wide")
    narrow = wide.isEmpty()
    only = lambda d: d if narrow else d.join(wide, "a", "left_anti")
    low, high = one.agg(F.min("a"), F.max("a")).first()
    kind = one.schema["a"].dataType.simpleString()
    if kind == "bigint" and low is not None and -(1 << 31) <= low and high < 1 << 31:
        kind = "int"
    lists = materialize(_lists(only(adj), kind, parts), "neighbour_lists")
    near = _reached(only(light).select("a", "b"), lists, kind, parts)
    if not none:
        sets, unions, nums = hub_unions(adj, hubs)
        # the sets themselves are needed again only beside a hub
        met = near.join(sets, "a", "left")
        near = materialize(met.select("a", F.size("cs").alias("e"), F.size("rs").alias("er"), F.when(F.col("s3").isNotNull(), F.col("cs")).alias("cs")), "reached")
        reached = near.select("a", F.explode("cs").alias("c")).withColumn("c", F.col("c").cast(one.schema["a"].dataType))
        sized = near.select("a", "e", "er")
    else:
        sized = near.select("a", F.size("cs").alias("e"), F.size("rs").alias("er"))
    if not narrow:
        broad = adj.join(wide, "a", "left_semi")
        steps = light.join(wide, "a", "left_semi").select("a", "b").join(
            adj.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("rb").alias("rc")), "b")
        rows = steps.select("a", "c", "rc").unionByName(broad.select("a", F.col("b").alias("c"), F.col("rb").alias("rc")))
        rows = materialize(rows.where(F.col("a") != F.col("c")).distinct(), "reached_wide")
        sized = sized.unionByName(rows.groupBy("a").agg(F.count(F.lit(1)).alias("e"), F.sum("rc").alias("er")))
        reached = reached.unionByName(rows.select("a", "c"))
    counts = one.join(sized, "a", "left")
    e, er = (F.coalesce(F.col(c), F.lit(0)) for c in ("e", "er"))
    n2, r2 = e - F.col("o1"), er - F.col("q1")
    if not none:
        words = unions.select(*SET, "bucket", F.inline("words"))
        sizes = words.groupBy(*SET).agg(F.sum(F.bit_count("bits")).alias("u"), F.sum(F.bit_count("risky_bits")).alias("ur"))
        place = nums.select(F.col("id").alias("c"), "num")
        at = _words(reached.join(place, "c").select("a", "num", F.lit(0).alias("rb")), ["a"]).select("a", "bucket", "word", F.col("bits").alias("here"))
        both = at.join(sets, "a").join(words, [*SET, "bucket", "word"])
        shared = lambda bits: F.sum(F.bit_count(F.col("here").bitwiseAND(F.col(bits))))
        both = both.groupBy("a").agg(shared("bits").alias("eu"), shared("risky_bits").alias("eur"))
        own = sets.join(flag.withColumnRenamed("b", "a"), "a", "left").join(sizes, SET).select(
            "a", (F.col("u") - 1).alias("u"), (F.col("ur") - F.coalesce("rb", F.lit(0))).alias("ur"))
        counts = counts.join(own, "a", "left").join(both, "a", "left")
        part = lambda c: F.coalesce(F.col(c), F.lit(0))
        n2, r2 = n2 + part("u") - part("eu"), r2 + part("ur") - part("eur")
    return counts.select("a", "n1", "r1", n2.cast("long").alias("n2"), r2.cast("long").alias("r2"))


# ---------------------------------------------------------------------------
# Weakly connected components: large-star / small-star
# ---------------------------------------------------------------------------

def _minima(pairs: DataFrame, value, *more) -> DataFrame:
    """(u, m) and ``more`` per u, written: the join that follows is then a plain shuffle on both sides, and Spark splits
    the rows of a component's root, which in the end holds its whole component."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("mv"), F.max("v").alias("last")).select("u", value.alias("m"), *more), "cc_minima")


def _lowest(e: DataFrame) -> DataFrame:
    """(u, m, alone) for the large-star step: m is the smallest of u and its neighbours, and ``alone`` says that u is
    smaller than all of them or has one only.  Both directions of an edge are made in one task, so a node's rows meet
    before the shuffle."""
    both = e.select(F.inline(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))))
    return _minima(both, F.least("u", "mv"), ((F.col("u") < F.col("mv")) | (F.col("mv") == F.col("last"))).alias("alone"))


def _edge_set(e: DataFrame, parts: int, name: str) -> DataFrame:
    """The distinct edges, written.  Edges to a root compress so well that tasks sized by bytes would hold very many."""
    return materialize(e.repartition(parts, "x", "y").distinct(), name)


def _star_round(e: DataFrame, low: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (x, y) with x > y; each step's table is written.

    ``low``: :func:`_lowest` of ``e``.  Repeats that the large-star step makes go with those of the small-star step:
    there are never more rows than edges and nodes.
    """
    large = materialize(e.select("x", F.col("y").alias("u")).join(low.select("u", "m"), "u").select("x", F.col("m").alias("y")), "cc_large")
    down = large.select(F.col("x").alias("u"), F.col("y").alias("v"))
    least = _minima(down, F.col("mv"))
    out = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(
        least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    parts = parts_for(e.sparkSession, large.count() + least.count())
    out = _edge_set(out, parts, "cc_edges")
    discard(least, large)
    return out


def _is_star_forest(low: DataFrame) -> bool:
    """Every child has one parent and no parent is itself a child; ``low`` from :func:`_lowest`."""
    return low.where(~F.col("alone")).isEmpty()


def connected_components(node_ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, component) with component = smallest id in the weak component, and the rounds it took.

    Alternates large-star and small-star until the edge set is a star forest
    (each node points at its component minimum); there is no other way out of
    the loop.  Each round's edge set is written to the shared folder, so lineage
    stays one round deep, and the one before is deleted.  Whether it is a star
    forest is seen in the minima that the next round needs anyway.
    """
    e = materialize(
        edges.select(F.greatest("src", "dst").alias("x"), F.least("src", "dst").alias("y"))
        .where(F.col("x") != F.col("y")), "cc_edges")  # repeats go in the first round
    rounds = 0
    low = _lowest(e)
    while not _is_star_forest(low):
        before, e = e, _star_round(e, low)
        discard(before, low)
        low = _lowest(e)
        rounds += 1
    discard(low)
    if not rounds:
        e = e.distinct()
    # every node with an edge to another one stands in the forest; loops (and missing ends) are left
    loops = edges.where(F.coalesce(F.col("src") == F.col("dst"), F.lit(True)))
    ids = node_ids.select("id")
    for more in (e.select("x"), e.select("y").distinct(), loops.select("src"), loops.select("dst")):
        ids = ids.union(more)
    ids = ids.distinct()
    comp = ids.join(e.select(F.col("x").alias("id"), F.col("y").alias("parent")), "id", "left").select(
        "id", F.coalesce(F.col("parent"), F.col("id")).alias("component"))
    return comp, rounds


def component_summary(comp: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """One row: component_count, largest_component_size, singleton_count (over node rows)."""
    c = comp if node_ids is None else comp.join(node_ids.select("id"), "id", "left_semi")
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("component_count"),
        F.max("size").alias("largest_component_size"),
        F.sum((F.col("size") == 1).cast("long")).alias("singleton_count"),
    )

