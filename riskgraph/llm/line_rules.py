"""Quality rules with cross-document line frequency.

Per text, base rules count words, symbols, repeated lines and repeated word windows.  Across texts,
normalised lines (lower case, white space collapsed, digits as 0) are hashed, and the different texts
of one host that hold a line are counted.  A line found in more than ``min_texts`` texts of its host
is boilerplate and is removed, however many other texts the host has; a document whose lines lose more
than ``max_removed`` of their characters is depleted and rejected.  A caller may ask for more than a
share ``max_share`` of the host's texts besides; by default the count alone decides.

Only DataFrame functions are used.  The text is read once: counts and line hashes go to one table in
the shared folder.  Exact copies count as one text; all that follows is keyed by (host, text), so
copies and repeated rows are aggregated on the map side before any shuffle, and a frequent line is
counted by partial sums.  The table of boilerplate lines is written before it is joined, so Spark
knows its size and may split a hot line's rows.

Defined results: null text counts as empty (no words: base_failed); a null host is a host of its own;
repeated rows each get a row; ties need no rule (counts only); other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.tables import discard, written

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def window_hashes(words: Column, n: int = 3) -> Column:
    """Hashes of all windows of n words in order."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))


def repeated_starts(placed: Column) -> Column:
    """Sorted starts of the windows that occur twice or more; ``placed`` is the sorted column of
    (hash h, start i), where equal hashes are neighbours."""
    same = lambda k, x: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))


def covered_words(starts: Column, n: int = 3) -> Column:
    """Words in the union of the windows of n words at these sorted starts."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                       lambda acc, s: F.struct((acc["n"] + (s + n - F.greatest(acc["end"], s))).alias("n"),
                                               (s + n).alias("end")), lambda acc: acc["n"])


def normalised(line: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(F.lower(line), SPACE_RUN, " "), "123456789", "000000000"))


def text_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Base counts of every document, its (host, text) key and its lines as (hash, characters)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    base = base.select(
        "doc_id", "host", "text", words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD_CHAR)).alias("lines"))
    base = base.select("doc_id", "host", "text", F.size("words").alias("n_words"), window_hashes(F.col("words")).alias("hashes"), "lines")
    # each step is its own projection: what a lambda looks up must be a column, or it is made anew for every element
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.select("doc_id", "host", "text", "n_words", "lines", F.when(repeats, placed).alias("placed"))
    base = base.withColumn("starts", F.when(F.col("placed").isNotNull(), repeated_starts(F.col("placed"))))
    return base.select(
        "doc_id", F.xxhash64("host", F.col("host").isNull()).alias("host_key"), F.xxhash64("text").alias("text_key"),
        F.col("n_words").cast("long").alias("n_words"), word_chars(F.col("text")).cast("long").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered_words(F.col("starts")), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), word_chars(x).alias("chars"))).alias("lines"))


def boilerplate(texts: DataFrame, min_texts: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    """(boilerplate lines of hosts: host_key, line; lines of texts: host_key, text_key, line, chars).
    ``chars`` is summed over a text's copies."""
    lines = texts.select("host_key", "text_key", F.explode("lines").alias("x")).groupBy(
        "host_key", "text_key", F.col("x.line").alias("line")).agg(F.sum("x.chars").alias("chars"))
    lines = written(lines, "text_lines")
    often = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_texts)
    if max_share > 0:
        hosts = texts.select("host_key", "text_key").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("n_texts"))
        often = often.join(hosts, "host_key").where(F.col("n") > max_share * F.col("n_texts"))
    return written(often.select("host_key", "line"), "boilerplate_lines"), lines


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_texts: int = 10,
          max_share: float = 0.0, max_removed: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars."""
    texts = written(text_rules(docs, id_col, host_col, text_col), "text_rules")
    often, lines = boilerplate(texts, min_texts, max_share)
    removed = written(
        lines.join(often, ["host_key", "line"]).groupBy("host_key", "text_key").agg(F.sum("chars").alias("removed")), "removed_chars")
    copies = texts.groupBy("host_key", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    per_text = written(removed.join(copies, ["host_key", "text_key"]).select(
        "host_key", "text_key", (F.col("removed") / F.col("copies")).cast("long").alias("removed_chars")), "removed_per_text")
    discard(often, lines, removed)
    out = texts.drop("lines").join(per_text, ["host_key", "text_key"], "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    gone = F.coalesce("removed_chars", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & (gone <= max_removed * F.col("word_chars"))).alias("kept"), gone.alias("removed_chars"))
