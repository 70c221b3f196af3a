"""Guidance corpus: page scan with source metadata, chunking, keyword counts
and keyword retrieval (top-k chunks per triggered-rule set).

Retrieval never pairs every case with every chunk.  One pass over the text
gives a postings table (keyword, chunk, count); a join on the keyword sums it per
chunk and list (one list per rule, one of default keywords).  A rule set's score is
a sum of at most six lists.  The top k of a rule set come from the heads of its
lists (threshold algorithm), so most chunks are never scored, and cases join the
top k of their own rule set.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import config as C
from riskgraph.functions.text import chunk_id, chunk_texts, excerpt, normalise_ws, substring_count
from riskgraph.operators.sampling import top_per_group
from riskgraph.session import literal_rows, materialize

RETRIEVAL_RULES = C.SUPPORTED_RULE_IDS  # bit i of a rule mask = RETRIEVAL_RULES[i]
N_MASKS = 1 << len(RETRIEVAL_RULES)


def source_table(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("source_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("publisher", T.StringType(), False),
        T.StructField("source_rank", T.IntegerType(), False),
    ])
    rows = [(sid, title, url, pub, i) for i, (sid, title, url, pub) in enumerate(C.GUIDANCE_SOURCES)]
    return literal_rows(spark, rows, schema.simpleString())


def corpus_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(source_id, title, publisher, url, source_rank, page, text) with whitespace normalised.

    Sources outside the configured list keep their id as title and rank after
    the configured ones.
    """
    src = F.broadcast(source_table(spark))  # fixed, configured list
    return (
        pages.join(src, "source_id", "left")
        .select(
            "source_id",
            F.coalesce(F.col("title"), F.col("source_id")).alias("title"),
            F.coalesce(F.col("publisher"), F.lit("")).alias("publisher"),
            F.coalesce(F.col("url"), F.lit("")).alias("url"),
            F.coalesce(F.col("source_rank"), F.lit(len(C.GUIDANCE_SOURCES))).alias("source_rank"),
            F.col("page").cast("long").alias("page"),
            normalise_ws(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        )
    )


def corpus_chunks(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per kept chunk, numbered from 1 per page after filtering."""
    p = corpus_pages(spark, pages)
    exploded = p.select(
        "source_id", "title", "publisher", "url", "source_rank", "page",
        F.posexplode(chunk_texts(F.col("text"))).alias("pos", "text"),
    )
    return exploded.select(
        "source_id", "title", "publisher", "url", "source_rank", "page",
        (F.col("pos") + 1).cast("int").alias("chunk_no"),
        chunk_id(F.col("source_id"), F.col("page"), F.col("pos") + 1).alias("chunk_id"),
        "text",
    )


def keyword_vocabulary(rule_keywords=None, default_keywords=None) -> list[str]:
    rk = rule_keywords or C.RULE_KEYWORDS
    dk = default_keywords if default_keywords is not None else C.DEFAULT_KEYWORDS
    vocab: list[str] = []
    for rid in RETRIEVAL_RULES:
        for kw in rk.get(rid, []):
            if kw.lower() not in vocab:
                vocab.append(kw.lower())
    for kw in dk:
        if kw.lower() not in vocab:
            vocab.append(kw.lower())
    return vocab


def keyword_counts(chunks: DataFrame, vocab: list[str]) -> DataFrame:
    """(chunk_id, ..., counts array<long>) aligned with ``vocab`` (whole chunk text, lowercased)."""
    low = F.lower(F.col("text"))
    counts = F.array(*[substring_count(low, F.lit(kw)) for kw in vocab])
    return chunks.withColumn("kw_counts", counts)


def _multiset_sum(counts: Column, vocab: list[str], keywords: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for kw in keywords:
        total = total + counts[vocab.index(kw.lower())]
    return total


def mask_scores(chunks: DataFrame, rule_keywords=None, default_keywords=None,
                wanted_masks: Column | None = None) -> DataFrame:
    """(rule_mask, chunk columns..., retrieval_score) for score > 0, all rule sets.

    Keyword counts (one array per chunk over the vocabulary) are summed per
    rule in one projection; each rule set's score is then a sum of at most six
    columns.  Repeated keywords count once per occurrence in the multiset.
    """
    rk = rule_keywords or C.RULE_KEYWORDS
    dk = default_keywords if default_keywords is not None else C.DEFAULT_KEYWORDS
    vocab = keyword_vocabulary(rk, dk)
    kc = keyword_counts(chunks, vocab)
    cnt = F.col("kw_counts")
    base_cols = list(chunks.columns)
    per_rule = kc.select(
        *base_cols,
        _multiset_sum(cnt, vocab, dk).alias("_s_base"),
        *[_multiset_sum(cnt, vocab, rk.get(rid, [])).alias(f"_s{i}") for i, rid in enumerate(RETRIEVAL_RULES)],
    )
    scores = []
    for m in range(N_MASKS):
        s = F.col("_s_base")
        for i in range(len(RETRIEVAL_RULES)):
            if m & (1 << i):
                s = s + F.col(f"_s{i}")
        scores.append(F.struct(F.lit(m).alias("rule_mask"), s.alias("retrieval_score")))
    arr = F.array(*scores)
    if wanted_masks is not None:
        # only the rule sets that occur (at most 32) are expanded per chunk
        arr = F.filter(arr, lambda x: F.array_contains(wanted_masks, x["rule_mask"]))
    return (
        per_rule.select(*base_cols, F.inline(arr))
        .where(F.col("retrieval_score") > 0)
    )


CHUNK_KEY = ["chunk_id", "page", "source_rank", "source_id", "chunk_no"]
LISTS = [*RETRIEVAL_RULES, "default"]  # the default list belongs to every rule set


def _overlaps_itself(keyword: str) -> bool:
    return any(keyword.endswith(keyword[:n]) for n in range(1, len(keyword)))


def scan_pattern(vocab: list[str]) -> str:
    """Finds, at every place, the longest keyword that starts there; a place that starts none by its first character
    is left at once."""
    longest_first = sorted(vocab, key=lambda k: (-len(k), k))
    first = "".join(re.escape(c) for c in sorted({k[0] for k in vocab if k}))
    guard = f"(?=[{first}])" if all(vocab) and first else ""
    return guard + "(?=(" + "|".join(re.escape(k) for k in longest_first) + "))"


def postings(chunks: DataFrame, vocab: list[str]) -> DataFrame:
    """(keyword, n, chunk key) of every keyword that a chunk holds, lowercased, counted without overlap.

    One scan of the text finds, at every place, the longest keyword that starts there; keywords that are its beginnings
    start there too.  Only a keyword that can overlap itself needs a scan of its own.
    """
    low = F.lower(F.col("text"))
    found = chunks.select(*CHUNK_KEY, low.alias("low"), F.regexp_extract_all(low, F.lit(scan_pattern(vocab)), F.lit(1)).alias("found"))
    count = lambda k: (
        substring_count(F.col("low"), F.lit(k)) if _overlaps_itself(k) else F.size(F.filter("found", lambda m: m.startswith(k))))
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), count(k).cast("long").alias("n")) for k in vocab])
    return found.select(*CHUNK_KEY, F.inline(F.filter(rows, lambda r: r["n"] > 0)))


def list_scores(posted: DataFrame, rule_keywords=None, default_keywords=None) -> DataFrame:
    """(chunk key, s_R001 ... s_R005, s_default): the chunk's score in every list.

    A join on the keyword with a table of how often each list names it (repeats count), then one grouped sum.
    """
    rk = rule_keywords or C.RULE_KEYWORDS
    named = {rid: [k.lower() for k in rk.get(rid, [])] for rid in RETRIEVAL_RULES}
    named["default"] = [k.lower() for k in (default_keywords if default_keywords is not None else C.DEFAULT_KEYWORDS)]
    vocab = sorted({k for ks in named.values() for k in ks})
    times = literal_rows(posted.sparkSession, [(k, *[named[x].count(k) for x in LISTS]) for k in vocab],
                         "keyword string, " + ", ".join(f"t_{x} int" for x in LISTS))
    met = posted.join(F.broadcast(times), "keyword")  # the configured vocabulary
    return met.groupBy(*CHUNK_KEY).agg(*[F.sum(F.col("n") * F.col(f"t_{x}")).alias(f"s_{x}") for x in LISTS])


def lists_of(mask: int) -> list[str]:
    """The lists of a rule set."""
    return [rid for i, rid in enumerate(RETRIEVAL_RULES) if mask & (1 << i)] + ["default"]


def _set_rows(scores: DataFrame, masks: list[int]) -> DataFrame:
    """(rule_mask, chunk key, retrieval_score) above 0 of the given rule sets."""
    rows = F.array(*[F.struct(F.lit(m).alias("rule_mask"), sum((F.col(f"s_{x}") for x in lists_of(m)), F.lit(0)).cast("long").alias("retrieval_score"))
                     for m in masks])
    return scores.select(*CHUNK_KEY, F.inline(F.filter(rows, lambda r: r["retrieval_score"] > 0)))


def set_scores(scores: DataFrame, masks=range(N_MASKS)) -> DataFrame:
    """The score of every chunk for the given rule sets (all 32 by default); ``scores`` from :func:`list_scores`."""
    return _set_rows(scores, list(masks))


def topk_by_threshold(scores: DataFrame, k: int = C.TOP_K_CHUNKS, masks=range(N_MASKS), depth: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rule_mask, chunk key, retrieval_score, chunk_rank) of the top k chunks of each rule set, and the chunks that
    were scored for it.

    Threshold algorithm: the heads of all lists are read to a depth; a chunk outside the heads of a set's lists scores
    at most the sum of their last values.  Once a set's k-th score is above that bound, its top k are final; the
    others go four times as deep.  A list that has been read to its end bounds by 0.  ``scores`` is a written table.
    """
    scores = scores.where(sum((F.col(f"s_{x}") for x in LISTS), F.lit(0)) > 0)
    lists = scores.select(*CHUNK_KEY, F.inline(F.filter(F.array(*[
        F.struct(F.lit(x).alias("list"), F.col(f"s_{x}").alias("s")) for x in LISTS]), lambda r: r["s"] > 0)))
    order = [F.desc("s"), *[F.col(c) for c in CHUNK_KEY[1:]]]
    open_masks, done, touched = list(masks), [], []
    while open_masks:
        heads = materialize(top_per_group(lists, ["list"], order, depth, rank_col="place", salt_key=F.col("chunk_id")), "list_heads")
        ends = {r["list"]: (r["rows"], r["last"]) for r in heads.groupBy("list").agg(
            F.count(F.lit(1)).alias("rows"), F.min("s").alias("last")).collect()}  # one row per list
        bound = {x: ends[x][1] if x in ends and ends[x][0] >= depth else 0 for x in LISTS}
        seen = scores.join(heads.select("chunk_id").distinct(), "chunk_id", "left_semi")
        # a set looks at the heads of its own lists only
        member = heads.groupBy("chunk_id").agg(F.collect_set("list").alias("in_lists"))  # at most six
        own = F.array(*[F.struct(F.lit(m).alias("rule_mask"), F.array(*[F.lit(x) for x in lists_of(m)]).alias("own")) for m in open_masks])
        wanted = member.select("chunk_id", "in_lists", F.inline(own)).where(F.arrays_overlap("in_lists", "own")).select("rule_mask", "chunk_id")
        found = materialize(_set_rows(seen, open_masks).join(wanted, ["rule_mask", "chunk_id"]), "set_heads")
        best = top_per_group(found, ["rule_mask"], retrieval_order(), k, rank_col="chunk_rank", salt_key=F.col("chunk_id"))
        best = materialize(best, "set_top")
        last = {r["rule_mask"]: r["s"] for r in best.where(F.col("chunk_rank") == k).select(
            "rule_mask", F.col("retrieval_score").alias("s")).collect()}  # at most one row per set
        final = [m for m in open_masks if last.get(m, 0) > sum(bound[x] for x in lists_of(m)) or not any(bound[x] for x in lists_of(m))]
        if final:
            done.append(best.where(F.col("rule_mask").isin(final)))
            touched.append(found.where(F.col("rule_mask").isin(final)).select("rule_mask", "chunk_id"))
        open_masks = [m for m in open_masks if m not in final]
        depth *= 4
    if not done:
        none = scores.select(F.lit(0).alias("rule_mask"), *CHUNK_KEY, F.lit(0).cast("long").alias("retrieval_score"), F.lit(1).alias("chunk_rank")).limit(0)
        return none, none.select("rule_mask", "chunk_id")
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, touched)


def retrieval_order() -> list[Column]:
    return [F.col("retrieval_score").desc(), F.col("page").asc(), F.col("source_rank").asc(),
            F.col("source_id").asc(), F.col("chunk_no").asc()]


def topk_per_mask(scored_chunks: DataFrame, k: int = C.TOP_K_CHUNKS, masks: DataFrame | None = None) -> DataFrame:
    """Top k chunks per rule set, ranked 1..k, without their text."""
    df = scored_chunks.drop("text")
    if masks is not None:
        df = df.join(F.broadcast(masks.select("rule_mask").distinct()), "rule_mask", "left_semi")  # <= 32 rows
    return top_per_group(df, ["rule_mask"], retrieval_order(), k, rank_col="chunk_rank", salt_key=F.col("chunk_id"))


def with_excerpts(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """The few winning chunks (at most 32 x k rows) with their text and excerpt, cut after scoring."""
    return top.join(chunks.select("chunk_id", *[c for c in ("source_id", "title", "publisher", "url", "page", "text") if c not in top.columns]), "chunk_id").withColumn("excerpt", excerpt(F.col("text")))


def rule_mask(hit_cols: list[str] | None = None) -> Column:
    """Bit mask of the triggered supported rules (R001 = bit 0 ... R005 = bit 4)."""
    m = F.lit(0)
    for i, rid in enumerate(RETRIEVAL_RULES):
        m = m + F.when(F.col(f"{rid}_hit"), F.lit(1 << i)).otherwise(F.lit(0))
    return m


def retrieve_for_cases(cases: DataFrame, chunks: DataFrame, k: int = C.TOP_K_CHUNKS,
                       rule_keywords=None, default_keywords=None, scores: DataFrame | None = None) -> DataFrame:
    """(id, chunk_rank, chunk columns, retrieval_score, excerpt) for each case; ``scores`` are the chunks' written list scores,
    if there are any."""
    with_mask = cases.select("id", rule_mask().alias("rule_mask"))
    # the rule sets present among the cases: at most 32 small integers
    present = sorted(r[0] for r in with_mask.select("rule_mask").distinct().collect())
    if scores is None:
        posted = postings(chunks, keyword_vocabulary(rule_keywords, default_keywords))
        scores = materialize(list_scores(posted, rule_keywords, default_keywords), "list_scores")
    top, _ = topk_by_threshold(scores, k, present)
    top = with_excerpts(top.select("rule_mask", "chunk_id", "chunk_rank", "retrieval_score"), chunks)
    return with_mask.join(top, "rule_mask")
