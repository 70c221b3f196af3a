"""Similarity self-join on word shingles with Bayesian candidate pruning.

1. Every text gets MinHash values of its five-word shingles; exact copies become one text.
2. Bands of MinHash values find candidates: texts that share a band are tied to the band's smallest
   member (rows linear in the band's size), and ties give candidate groups.  With 32 bands of 5 values
   two texts at similarity 0.8 share no band with probability 3e-6, less above it.
3. A group is dealt into chunks of bounded size, and every pair of chunks is one small group of rows.
   There the MinHash values of its pairs are compared 20 at a time.  With a uniform prior, the
   posterior probability that a pair reaches the threshold after m matches in n values is
   P(Binomial(n + 1, threshold) <= m); pairs below ``tolerance`` are dropped, what is left is verified
   exactly on the shingle sets.
4. Only link counts per text and a spanning forest of the links leave the chunk pairs, so no row per
   pair is ever made; components of the forests are the classes.

Result per document: class_id (smallest doc_id that similarity links reach) and n_links (other documents
at or above the threshold, copies included without being spelled out).

Defined results: null text counts as empty; texts without words have no links and stand alone even if
copied; a text of fewer than five words has one shingle; repeated rows are copies; null ids are carried,
and a class whose ids are all null has a null class_id; extra columns are not carried.  The comparisons in
one candidate group grow with the square of its different texts (they are needed to count links), spread over
chunk pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.components import components
from riskgraph.llm.shingles import minhashes, sets
from riskgraph.llm.tables import discard, written

THRESHOLD = (4, 5)  # as a fraction, so that the exact test is in whole numbers
BANDS, ROWS = 32, 5
STEP = 20
TOLERANCE = 1e-7
CHUNK_TEXTS, CHUNK_CHARS = 192, 4_000_000
NO_ID = 2**63 - 1  # stands for null; larger than any id, so that a copy with an id represents the text


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches in n values at which the posterior probability of reaching the threshold is at
    least ``tolerance``."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def pruned_pairs(u: np.ndarray, v: np.ndarray, same: bool, least: dict[int, int]) -> np.ndarray:
    """Index pairs whose MinHash values, compared step by step, keep the threshold credible."""
    i, j = np.triu_indices(len(u), 1) if same else (x.ravel() for x in np.indices((len(u), len(v))))
    matches = np.zeros(len(i), np.int16)
    for n, need in least.items():
        step = slice(n - STEP, n)
        matches += (u[i, step] == v[j, step]).sum(axis=1, dtype=np.int16)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
    return np.column_stack([i, j])


def linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    """Exact Jaccard test of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or threshold[1] * len(a) < threshold[0] * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return threshold[1] * common >= threshold[0] * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """id, key, and MinHash values of every text with words.  ``docs``: id, key, text."""
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                texts = part.column(2).to_pylist()
                values = minhashes(texts, BANDS * ROWS)
                full = pa.array([bool(t.strip(" \t\n\x0b\x0c\r")) for t in texts])
                flat = pa.array(values.view(np.int32).ravel(), pa.int32())
                lists = pa.FixedSizeListArray.from_arrays(flat, BANDS * ROWS).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "key", "minhash"]).filter(full)

    return docs.mapInArrow(run, "id long, key binary, minhash array<int>")


def candidate_groups(texts: DataFrame) -> DataFrame:
    """(node, label) of texts (node, minhash) that share a band with another, label naming the group."""
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("minhash")[k * ROWS + r] for r in range(ROWS)]) for k in range(BANDS)])
    bands = texts.select("node", F.explode(keys).alias("band"))
    lows = written(bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                       .where("low != high").select("band", "low"), "bands")
    groups = components(bands.join(lows, "band").where("node != low").select("node", "low"), "node", "low")
    discard(lows)
    return groups


def _compare(least: dict[int, int], threshold: tuple[int, int]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of chunks: links counted per text, and a spanning forest of the links."""
        one, two = key[1], key[2]
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        left = np.flatnonzero(rows["chunk"].to_numpy() == one)
        right = np.flatnonzero(rows["chunk"].to_numpy() == two)
        values = np.array(rows["minhash"].tolist(), np.int32).reshape(len(rows), -1)
        pairs = pruned_pairs(values[left], values[right], one == two, least)
        counts, parent, forest = np.zeros(len(rows), np.int64), list(range(len(rows))), []
        if len(pairs):
            copies = rows["copies"].to_numpy()
            needed = np.unique(np.concatenate([left[pairs[:, 0]], right[pairs[:, 1]]]))
            own = dict(zip(needed.tolist(), sets(rows["text"].iloc[needed].tolist())))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i, j in zip(left[pairs[:, 0]].tolist(), right[pairs[:, 1]].tolist()):
                if linked(own[i], own[j], threshold):
                    counts[i] += copies[j]
                    counts[j] += copies[i]
                    if (x := root(i)) != (y := root(j)):
                        parent[x] = y
                        forest.append((i, j))
        node = rows["node"].to_numpy()
        hit = np.flatnonzero(counts)
        found = pd.DataFrame({"node": node[hit], "links": counts[hit], "other": pd.array([None] * len(hit), "Int64")})
        if forest:
            i, j = np.array(forest).T
            found = pd.concat([found, pd.DataFrame({"node": node[i], "links": 0, "other": pd.array(node[j], "Int64")})])
        return found

    return run


def link_rows(docs: DataFrame, texts: DataFrame, groups: DataFrame, threshold: tuple[int, int], tolerance: float) -> DataFrame:
    """(node, links, other): link counts (other is null) and forest edges (links is 0).  A node may have several rows."""
    least = {n: least_matches(n, threshold[0] / threshold[1], tolerance) for n in range(STEP, BANDS * ROWS + 1, STEP)}
    members = texts.join(groups, "node").select("node", "label", "key", "rep", "copies", "minhash")
    # one document of each text brings the text itself: the join is on key and id, so copies are not gathered
    full = docs.withColumnRenamed("id", "rep").join(members, ["key", "rep"]).select("node", "label", "copies", "minhash", "text")
    full = written(full, "group_texts")
    sizes = full.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = written(sizes.select("label", F.ceil(F.greatest(F.col("n") / CHUNK_TEXTS, F.col("chars") / CHUNK_CHARS)).cast("int").alias("k")),
                    "group_sizes")
    dealt = full.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(
        F.least("chunk", x).alias("one"), F.greatest("chunk", x).alias("two")))
    blocks = dealt.withColumn("pair", F.explode(others)).select(
        "label", F.col("pair.one").alias("one"), F.col("pair.two").alias("two"), "chunk", "node", "copies", "minhash", "text")
    found = written(blocks.groupBy("label", "one", "two").applyInPandas(_compare(least, threshold), "node long, links long, other long"), "links")
    discard(full, sizes)
    return found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
         tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links and text_key (the digest that copies share) of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    rows = rows.select("id", F.unhex(F.md5("text")).alias("key"), "text")
    # node: a short name of a text; should two texts ever share one, they are compared as one group
    texts = signatures(rows).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("minhash").alias("minhash"))
    texts = written(texts.withColumn("node", F.xxhash64("key")), "texts")
    groups = candidate_groups(texts)
    found = link_rows(rows, texts, groups.select("node", "label"), threshold, tolerance)
    labels = components(found.where("other is not null"), "node", "other")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = texts.select("key", "node", "rep", "copies").join(counts, "node", "left").join(labels.select("node", "label"), "node", "left").select(
        "key", F.coalesce("label", "node").alias("label"), "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = written(known, "text_classes")
    discard(texts, groups, found, labels)
    first = known.groupBy("label").agg(F.min(F.when(F.col("rep") != NO_ID, F.col("rep"))).alias("class_id"))
    classes = written(known.join(first, "label").select("key", "class_id", "n_links"), "classes")
    discard(known)
    return rows.select("id", "key").join(classes, "key", "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.when(F.col("n_links").isNull(), F.nullif("id", F.lit(NO_ID))).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.hex("key").alias("text_key"))
