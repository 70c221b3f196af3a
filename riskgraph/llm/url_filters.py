"""URL filtering by association rules.

URLs with a known label become baskets of tokens (host names, host words, path words, extension, query
keys, fragment, scheme) plus one label token.  Tokens that occur in exactly the same labelled URLs are one item (so a
long URL that is repeated is one item, not all combinations of its words).  Spark's FP-growth mines frequent
combinations of items; rules that lead to a label token and reach the support and confidence asked for are kept.
For matching, a URL's tokens are turned into items, rules are indexed under their rarest item and joined with that
index, and a rule fits if all of its items occur, an item by any of its tokens: as many URLs as rules over all
combinations of tokens would fit, with the same confidence.  The most confident fitting rule decides (ties: higher lift, then block).

Hand-written (host, path) rules come before mined ones; the longest fitting one wins.

All steps are DataFrame operations.  A combination is frequent from ``min_count`` labelled URLs on,
however many others there are, so more data finds more of the rare hosts.  The frequent single tokens,
which FP-growth lists on the driver, are at most (labelled URLs x tokens per URL / ``min_count``).
Rules are matched per distinct set of tokens, verdicts kept per distinct URL, so a URL that fills a
third of the table is judged once; the last join carries no aggregate, so Spark may split a hot URL.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and the default
verdict; labels that are null are not used; without labelled rows no rule is mined; repeated rows
each get their row, repeated labelled URLs count each; very long URLs are read whole; an empty table gives no
rows; only the key and URL columns are carried, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.tables import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GOOD, BAD = "label=good", "label=bad"
ALLOW, BLOCK = "allow", "block"
RULE_SCHEMA = "rule_id long, items array<string>, anchor string, label string, confidence double, lift double, support double"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting (verdict, host, path) rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL.  Purely numeric path words are no tokens: they name single pages."""
    host, path = host_of(url), path_of(url)
    rest = F.coalesce(_rest(url), F.lit(""))
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    words = F.split(F.regexp_replace(host, r"[.]", "-"), "-")
    parts = F.filter(F.split(F.lower(path), "[/._-]+"), lambda w: (w != "") & ~w.rlike(r"\A[0-9]+\z"))
    keys = F.filter(F.split(query, "&"), lambda w: w != "")
    named = [
        F.transform(F.filter(labels, lambda w: w != ""), lambda w: F.concat(F.lit("host="), w)),
        F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("word="), w)),
        F.transform(parts, lambda w: F.concat(F.lit("path="), w)),
        F.transform(keys, lambda w: F.concat(F.lit("query="), F.split(w, "=")[0])),
        F.when(F.instr(rest, F.lit("#")) > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("scheme="), F.lower(F.coalesce(F.regexp_extract(url, r"\A([^:/?#]*):", 1), F.lit(""))))),
    ]
    # a word that is a whole label says the same as the label
    return F.array_distinct(F.filter(F.concat(*named), lambda t: ~(
        t.startswith("word=") & F.array_contains(labels, F.substring(t, 6, 1 << 20)))))


def merged_items(token_sets: DataFrame, min_count: int) -> DataFrame:
    """(token, item) of tokens in at least ``min_count`` labelled URLs.  ``token_sets``: distinct sets (url_tokens, n).
    Tokens with the same sets share an item, named by the smallest; sets are told by sums of their hashes."""
    one, two = F.xxhash64("url_tokens"), F.xxhash64(F.lit("sets"), "url_tokens")
    each = token_sets.select(one.alias("h1"), two.alias("h2"), "n", F.explode("url_tokens").alias("token"))
    same = ["h1", "h2", "n_sets", "freq"]
    tokens = each.groupBy("token").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n_sets"),
                                       F.sum("n").alias("freq")).where(F.col("freq") >= min_count)
    tokens = written(tokens, "url_token_counts")
    items = written(tokens.join(tokens.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item"), "url_items")
    discard(tokens)
    return items


def with_items(token_sets: DataFrame, items: DataFrame) -> DataFrame:
    """(url_tokens, items) of distinct token sets that hold any item."""
    found = token_sets.select("url_tokens", F.explode("url_tokens").alias("token")).join(items, "token")
    return found.groupBy("url_tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))  # at most one per token


def mine(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = 0.8, min_count: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rules, items) from ``labelled`` (url, bad boolean): rules (rule_id, items, anchor, label, confidence, lift, support), and
    items (token, item).  A combination must occur ``min_count`` times; ``min_support`` asks for a share of the labelled URLs besides."""
    spark = labelled.sparkSession
    rows = written(labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(
        F.array_sort(tokens_of(F.col("url"))).alias("url_tokens"), F.when(F.col("bad"), BAD).otherwise(GOOD).alias("label")), "url_baskets")
    n = rows.count()
    if n < min_count:
        discard(rows)
        return spark.createDataFrame([], RULE_SCHEMA), spark.createDataFrame([], "token string, item string")
    sets = rows.groupBy("url_tokens").agg(F.count(F.lit(1)).alias("n"))
    items = merged_items(sets, min_count)
    named = written(with_items(sets, items), "url_item_sets")
    none = F.array().cast("array<string>")
    baskets = written(rows.join(named, "url_tokens", "left").select(F.concat(F.coalesce("items", none), F.array("label")).alias("items")), "url_item_baskets")
    # FP-growth rounds support x rows up: half a row less, so that exactly min_count rows are enough
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(GOOD, BAD)).select(
        F.xxhash64(F.array_sort("antecedent"), "consequent").alias("rule_id"), F.array_sort("antecedent").alias("items"),
        F.col("consequent")[0].alias("label"), "confidence", "lift", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = (rules.select("rule_id", F.explode("items").alias("item")).join(single, "item")
              .groupBy("rule_id").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor")))
    rules = written(rules.join(rarest, "rule_id").select("rule_id", "items", "anchor", "label", "confidence", "lift", "support"), "url_rules")
    discard(rows, named, baskets)
    return rules, items


def match(token_sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """For distinct token sets (column url_tokens) that some mined rule fits: url_tokens, method_verdict, confidence, mined_rule."""
    named = with_items(token_sets, items).withColumnRenamed("items", "own")
    found = (named.select("url_tokens", "own", F.explode("own").alias("anchor")).join(rules, "anchor")
             .where(F.size(F.array_except("items", "own")) == 0))
    best = F.max(F.struct("confidence", "lift", (F.col("label") == BAD).alias("bad"), F.array_join("items", " ").alias("mined_rule")))
    return found.groupBy("url_tokens").agg(best.alias("b")).select(
        "url_tokens", F.when(F.col("b.bad"), BLOCK).otherwise(ALLOW).alias("method_verdict"),
        F.col("b.confidence").alias("confidence"), F.col("b.mined_rule").alias("mined_rule"))


def judge(pages: DataFrame, labelled: DataFrame, listed: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id",
          url_col: str = "url", default: str = ALLOW, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence and mined_rule (null unless a mined rule fits)."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    rules, items = mine(labelled, **mining)
    urls = rows.where("url is not null").select("url").distinct().select("url", F.array_sort(tokens_of(F.col("url"))).alias("url_tokens"))
    sets = written(match(urls.select("url_tokens").distinct(), rules, items), "url_token_sets")
    verdicts = written(urls.join(sets, "url_tokens").drop("url_tokens"), "url_verdicts")
    discard(sets)
    out = rows.join(verdicts, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "method_verdict", "confidence", "mined_rule")
    out = out.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"),
                      F.coalesce("listed.verdict", "method_verdict", F.lit(default)).alias("verdict"), "confidence", "mined_rule")
