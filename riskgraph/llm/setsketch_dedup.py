"""Near-duplicate components by SetSketch registers.

1. A text's set holds the 64-bit hashes of its distinct three-word shingles (A-Z read as a-z; fewer words make
   one shingle).  Register i of its sketch is floor(1 - log_b(smallest Exp(a) value of hash i over the set)), cut to
   [0, q + 1]: a truncated minimum on an exponentially spaced scale.  Registers of a union are the maxima of the
   registers, and two sets agree in a register with a probability that rises with their similarity.  Texts with
   the same set (copies, and texts that differ in white space or case alone) become one node.
2. Bands of 6 register values put nodes into buckets.  With 28 bands two sets at similarity 0.85 share no bucket
   with probability 2e-6, less above it.
3. A pair is judged by the joint likelihood of how many registers are larger, smaller and equal, given both set
   sizes: it is dropped if the likelihood at the threshold is below ``tolerance`` times the largest, with the estimate
   under the threshold.  What is left is verified on the full shingle sets.
4. Pivots first: each bucket's node of largest bucket mass (a centre of its copies) is compared with the other
   members, one row per member.  Verified links give classes.
5. Then buckets that still hold several classes are dealt into chunks of bounded size (nodes and shingles), and every
   pair of chunks is one small group of rows with sketches and sets.  There each pair of different classes is judged, in
   the first band it shares, and what stays credible is verified on the spot, the most likely first; a pair is left out
   only if both ends are linked already.  No row per pair is made: a spanning forest of the links leaves the group, so
   classes are exactly the components of the verified links.

Result per document: n_shingles, component_id (smallest doc_id that links reach, itself included) and kept
(doc_id equals component_id).

Defined results: null text counts as empty; texts without words have no shingle and stand alone, even if copied; a
very long text is hashed in segments with overlap, whole; ties and repeated rows are copies of one node; null ids are
carried: a class without any id has a null component_id, and its rows are kept; an empty table gives no rows; extra
columns, whatever their names, are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.components import components
from riskgraph.llm.shingles import grouped, mix, sets
from riskgraph.llm.tables import discard, written

WORDS = 3
THRESHOLD = (85, 100)  # as a fraction, so that the exact test is in whole numbers
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534  # b, a and q of the sketch: 16-bit registers
TOLERANCE = 1e-7
CHUNK_NODES, CHUNK_SHINGLES = 256, 1 << 20
PACK_NODES, PACK_SHINGLES = 2048, 1 << 21  # small buckets that one group of rows holds
BLOCK = 1 << 15
NO_ID = 2**63 - 1  # stands for null; larger than any id


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of the smallest 64-bit hash values."""
    exponential = -np.log1p(-(minima.astype(np.float64) + 0.5) * 2.0**-64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def sketch_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(set sizes, sketches, digests of the sets) of texts."""
    rng = np.random.default_rng(13)
    factor = rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
    n = np.zeros(len(texts), np.int64)
    out = np.zeros((len(texts), REGISTERS), np.uint16)
    digests = [bytes(24)] * len(texts)
    for at, h, first in grouped(texts, WORDS, fold=True):
        own = [np.unique(h[i:j]) for i, j in zip(first.tolist(), first[1:].tolist())]
        sizes = np.array([len(x) for x in own], np.int64)
        n[at:at + len(own)] = sizes
        filled = np.flatnonzero(sizes)
        if not len(filled):
            continue
        h = np.concatenate([own[i] for i in filled])
        starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
        for k in range(REGISTERS):
            out[at + filled, k] = registers(np.minimum.reduceat((h ^ offset[k]) * factor[k], starts))
        named = np.column_stack([np.add.reduceat(mix(h), starts), np.bitwise_xor.reduceat(mix(h ^ offset[0]), starts),
                                 sizes[filled].astype(np.uint64)])
        for i, row in zip((at + filled).tolist(), named):
            digests[i] = row.tobytes()
    return n, out, digests


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (which band it is counts)."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j: ``more`` registers of the first set are larger, ``less`` are smaller."""
    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = share(u - v * j), share(v - u * j)
    floor = 1e-300
    return more * np.log(np.maximum(p, floor)) + less * np.log(np.maximum(q, floor)) + (
        (REGISTERS - more - less) * np.log(np.maximum(1 - p - q, floor)))


def judge_pairs(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: tuple[int, int],
                tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, whether the threshold stays credible) of pairs of sketches."""
    swap = (n1 > n2) | ((n1 == n2) & (more < less))  # one order, so that a pair is always judged the same
    n1, n2 = np.where(swap, n2, n1), np.where(swap, n1, n2)
    more, less = np.where(swap, less, more), np.where(swap, more, less)
    u = n1 / (n1 + n2)
    v = 1 - u
    top = np.minimum(u / v, v / u)  # no similarity is above the quotient of the sizes
    low, high = np.zeros(len(u)), top.copy()
    for _ in range(24):  # the log-likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = _log_likelihood(a, more, less, u, v) < _log_likelihood(b, more, less, u, v)
        low, high = np.where(right, a, low), np.where(right, high, b)
    best = np.round((low + high) / 2, 6)
    at = threshold[0] / threshold[1]
    possible = threshold[1] * np.minimum(n1, n2) >= threshold[0] * np.maximum(n1, n2)
    credible = _log_likelihood(best, more, less, u, v) - _log_likelihood(np.minimum(top, at), more, less, u, v) <= -np.log(tolerance)
    return best, possible & ((best >= at) | credible)


def sketched(rows: DataFrame) -> DataFrame:
    """(id, text_key, key, n, sketch) of every row (id, text_key, text); key names the shingle set."""
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                n, values, digests = sketch_texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(n), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["id", "text_key", "key", "n", "sketch"])

    return rows.mapInArrow(run, "id long, text_key binary, key binary, n long, sketch binary")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, node, size) of all buckets that hold several nodes."""
    def run(batches):
        for b in batches:
            keys = band_keys(_sketches(b.column(1).to_pylist()))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["node", "bands"])

    keys = written(nodes.select("node", "sketch").mapInArrow(run, "node long, bands array<long>"), "bands")
    rows = keys.select("node", F.explode("bands").alias("band"))
    sizes = written(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket_sizes")
    out = written(rows.join(sizes, "band").select("band", "node", "size"), "buckets")
    discard(keys, sizes)
    return out


def pivot_pairs(members: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(x, y) of members and their bucket's pivot that the likelihood does not rule out."""
    mass = members.groupBy("node").agg(F.sum("size").alias("mass"))
    weighed = members.join(mass, "node")
    pivots = written(weighed.groupBy("band").agg(F.max_by("node", F.struct("mass", "node")).alias("pivot")), "pivots")
    pairs = written(members.join(pivots, "band").where("node != pivot").select(
        F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")).distinct(), "pivot_pairs")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def run(batches):
        for b in batches:
            if len(b):
                one, two = _sketches(b.column("sketch_x").to_pylist()), _sketches(b.column("sketch_y").to_pylist())
                _, keep = judge_pairs(b.column("n_x").to_numpy(), b.column("n_y").to_numpy(), (one > two).sum(1), (one < two).sum(1), threshold)
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(keep))

    out = written(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(run, "x long, y long"), "credible")
    discard(pivots, pairs)
    return out


def texts_of(needed: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the needed nodes: one document brings the text; rows that repeat it are dropped."""
    named = nodes.join(needed, "node").select("node", F.col("rep").alias("id"), "text_key")
    return rows.join(named, ["id", "text_key"]).select("node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) whose full shingle sets reach the threshold."""
    needed = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    texts = written(texts_of(needed, nodes, rows), "pair_texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                ends = [part.column(c).to_pylist() for c in ("x", "y")]
                texts = dict(zip(ends[0] + ends[1], part.column("text_x").to_pylist() + part.column("text_y").to_pylist()))
                new = [k for k in texts if k not in held]
                held = {k: held[k] for k in texts if k in held} | dict(zip(new, sets([texts[k] for k in new], WORDS, fold=True)))
                keep = [linked(held[x], held[y], threshold) for x, y in zip(*ends)]
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    out = written(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(run, "x long, y long"), "links")
    discard(texts)
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Exact test of two sorted sets."""
    if not len(a) or not len(b) or threshold[1] * min(len(a), len(b)) < threshold[0] * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return threshold[1] * common >= threshold[0] * (len(a) + len(b) - common)


def _pairs_of(chunk: np.ndarray, bounds: np.ndarray, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside each bucket (rows ``bounds[k]`` to ``bounds[k + 1]``) between two chunks."""
    i, j = [], []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if one == two:
            a, b = np.triu_indices(end - start, 1)
        else:
            left, right = (np.flatnonzero(chunk[start:end] == c) for c in (one, two))
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        i.append(a + start)
        j.append(b + start)
    return np.concatenate(i), np.concatenate(j)


def _compare(threshold: tuple[int, int]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Spanning forest of the links between classes, from one pair of chunks of each of some buckets."""
        rows = rows.sort_values(["band", "node"], ignore_index=True)
        band, node, label, n = (rows[c].to_numpy() for c in ("band", "node", "label", "n"))
        values, raw = _sketches(rows["sketch"]), rows["set"].tolist()
        keys = band_keys(values)
        earlier = np.cumsum(keys == band[:, None], axis=1) == 0  # bands before the one of this row
        bounds = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        i, j = _pairs_of(rows["chunk"].to_numpy(), bounds, key[1], key[2])
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        found = []
        for at in range(0, len(i), BLOCK):
            a, b = i[at:at + BLOCK], j[at:at + BLOCK]
            first = ~((keys[a] == keys[b]) & earlier[a]).any(axis=1)  # a pair counts in the first band it shares
            a, b = a[first], b[first]
            likely, keep = judge_pairs(n[a], n[b], (values[a] > values[b]).sum(1), (values[a] < values[b]).sum(1), threshold)
            found.append((a[keep], b[keep], likely[keep]))
        a, b, likely = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        forest = []
        own = lru_cache(maxsize=2 * CHUNK_NODES)(lambda k: np.frombuffer(raw[k], np.uint64))
        for k in np.argsort(-likely, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            one, two = root(int(label[x])), root(int(label[y]))
            if one != two and linked(own(x), own(y), threshold):
                parent[one] = two
                forest.append((node[x], node[y]))
        return pd.DataFrame(forest, columns=["x", "y"], dtype="int64")

    return run


def links_between(members: DataFrame, nodes: DataFrame, rows: DataFrame, labels: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(x, y): links that join the classes ``labels`` (node, label), found inside the buckets that hold several of them."""
    classed = members.select("band", "node").join(labels, "node", "left").join(nodes.select("node", "n"), "node").select(
        "band", "node", F.coalesce("label", "node").alias("label"), "n")
    mixed = classed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    chunks = F.ceil(F.greatest(F.col("rows") / CHUNK_NODES, F.col("size") / CHUNK_SHINGLES)).cast("int")
    mixed = written(mixed.where("low != high").select("band", "rows", "size", chunks.alias("k")), "mixed_buckets")
    total = mixed.agg(F.sum("rows").alias("rows"), F.sum("size").alias("size")).first()
    packs = max(1, (total["rows"] or 0) // PACK_NODES, (total["size"] or 0) // PACK_SHINGLES)
    rest = written(classed.join(mixed.select("band", "k"), "band"), "mixed_members")

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                own = [x.tobytes() for x in sets(part.column(1).to_pylist(), WORDS, fold=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["node", "set"])

    full = texts_of(rest.select("node").distinct(), nodes, rows).mapInArrow(run, "node long, set binary")
    full = written(full.join(nodes.select("node", "sketch"), "node"), "open_sets")
    dealt = rest.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least("chunk", x).alias("one"), F.greatest("chunk", x).alias("two")))
    blocks = dealt.withColumn("pair", F.explode(others)).select(
        F.when(F.col("k") == 1, F.pmod(F.xxhash64("band"), F.lit(packs))).otherwise(F.col("band")).alias("pack"),
        F.col("pair.one").alias("one"), F.col("pair.two").alias("two"), "band", "chunk", "node", "label", "n")
    out = written(blocks.join(full, "node").groupBy("pack", "one", "two").applyInPandas(_compare(threshold), "x long, y long"), "links")
    discard(mixed, rest, full)
    return out


def classes(nodes: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, label) of nodes with links; label is the component's smallest node."""
    members = buckets(nodes)
    pairs = pivot_pairs(members, nodes, threshold)
    links = verified(pairs, nodes, rows, threshold)
    labels = components(links, "x", "y")
    more = links_between(members, nodes, rows, labels.select("node", "label"), threshold)
    discard(members, pairs, labels)
    labels = components(links.unionByName(more), "x", "y")
    discard(links, more)
    return labels


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    rows = rows.select("id", F.unhex(F.md5("text")).alias("text_key"), "text")
    keyed = written(sketched(rows), "sketched")
    nodes = keyed.where("n > 0").groupBy("key").agg(
        F.min(F.struct("id", "text_key")).alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    # node: a short name of a set; sets that share one (64 bits) would be taken as one
    nodes = written(nodes.select("key", F.xxhash64("key").alias("node"), F.col("rep.id").alias("rep"), F.col("rep.text_key").alias("text_key"),
                                 "n", "sketch"), "nodes")
    labels = classes(nodes, rows, threshold)
    known = nodes.select("key", "rep", "node").join(labels.select("node", "label"), "node", "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    low = known.groupBy("label").agg(F.min("rep").alias("low"))
    known = written(known.join(low, "label").select("key", "low"), "set_classes")
    discard(nodes, labels)
    out = keyed.select("id", "key", "n").join(known, "key", "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("low", "id"), F.lit(NO_ID)).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
