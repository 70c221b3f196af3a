"""Spelling variants of the corpus vocabulary by a frontier over a relational trie.

1. Runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased; a run whose CRC-32 of
   ``<doc_id>:<run>`` is divisible by 97 loses the code point at CRC modulo its length.  Words are the distinct
   results of at least 5 code points that occur at least 3 times; counts are summed before the shuffle.
2. The trie of all words and of all reversed words is a table of edges (side, depth, node, piece), a node being the prefix it
   stands for, partitioned by depth.  A level reads one code point; below depth 8 the pieces grow with the depth, so
   very long words take few levels.  An edge to a node with one word below is a leaf: it reads the rest of that word.
3. Level by level, states (word, position, node, edits) are joined with the edges of that level.  Without an edit a state
   follows its own word; where a child's piece differs from the word's own, a replaced, an extra or a missing code point
   gives states with one edit, which from there on follow exact pieces only.  An edit is placed at the first piece
   that differs.  States with one edit that end in a word are its neighbours; at a leaf that is the lookup of a whole word.
   Edits are placed in the second half of a word only, on both sides: an edit in the first half is one in the second half
   read backwards, and deep nodes have few children where the root has the whole alphabet.  States without an edit need no
   frontier, since their node is a prefix of their word: all of them meet the edges in one join.  Edges know the lengths
   of the words below them and the code points that follow (as bits), so a state that cannot end in a word is dropped
   where it would begin.
   Levels end when no state is open.  Every level is one job that writes its frontier and counts its open states on the
   way: lineage ends there, and a lost executor repeats one level.
4. A word's form is its neighbour of largest count if that is at least twice the word's; roots follow forms by pointer
   doubling (counts at least double along a chain, so it has at most 63 steps).

Defined results: null text counts as empty; a null id reads as an empty text before the colon; ties of counts go to the
smallest word in code point order; repeated rows count again; very long texts are read whole and very long runs are words
like others; an empty table gives no rows; extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskgraph.llm.tables import discard, written

LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 5, 3
FAULT_EVERY = 97
SINGLE_LEVELS = 8  # levels of one code point; below, pieces grow


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the corpus."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % FAULT_EVERY == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.char_length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT))


def level(depth: int) -> int:
    """Code points that the pieces at this depth read."""
    return 1 if depth < SINGLE_LEVELS else 1 << ((depth // SINGLE_LEVELS).bit_length())


def levels(shortest: int, longest: int) -> list[tuple[int, int]]:
    """(depth, code points) of every level, from the middle of the shortest word on: a few for each doubling of the length."""
    out, depth = [], shortest // 2
    while depth < longest:
        out.append((depth, level(depth)))
        depth += level(depth)
    return out


def _piece(text: str, start: Column | int, size: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(F.col(text), lit(start) + 1, lit(size))


def _bit(place: str) -> str:
    return f"shiftleft(1L, cast({place} as int))"


def _has(bits: str, place: str) -> str:
    return f"(shiftright({bits}, cast({place} as int)) & 1) = 1"


def _at_levels(sides: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Every word (side, word) at every level: depth, size and the node that is its prefix there."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(s).alias("size")) for d, s in steps]))
    return sides.select("side", "word", each.alias("step")).select(
        "side", "word", "step.depth", "step.size", _piece("word", 0, F.col("step.depth")).alias("node"))


def edges(sides: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """(side, depth, node, piece, ends, leaf, lengths, follows): ends tells whether the child is a word, leaf whether one word
    only lies at or below it, lengths which lengths the words there have and follows which code points come after the child
    (bits of 64 classes)."""
    length = F.char_length("word")
    own = _at_levels(sides, steps).where(length > F.col("depth"))
    after = "substring(word, depth + size + 1, 1)"
    own = own.select(
        "side", "depth", "node", _piece("word", F.col("depth"), F.col("size")).alias("piece"), (length <= F.col("depth") + F.col("size")).alias("ends"),
        F.expr(_bit("least(char_length(word), 63)")).alias("length"), F.expr(f"if({after} = '', 0L, {_bit(f'ascii({after}) % 64')})").alias("follow"))
    return own.groupBy("side", "depth", "node", "piece").agg(
        F.max("ends").alias("ends"), (F.count(F.lit(1)) == 1).alias("leaf"), F.bit_or("length").alias("lengths"), F.bit_or("follow").alias("follows"))


def _alive(pos: str) -> Column:
    """Whether the state at ``pos`` of its word and at the child of an edge can end in a word: a word of the length it
    needs lies at or below the child, and either both are at their end or the word's next code point may follow."""
    after = f"substring(word, {pos} + 1, 1)"
    length = f"least(char_length(word) - ({pos}) + char_length(node) + char_length(piece), 63)"
    return F.expr(f"{_has('lengths', length)} AND (char_length(word) = {pos} AND ends OR {after} != '' AND {_has('follows', f'ascii({after}) % 64')})")


def _states(met: DataFrame) -> DataFrame:
    """States at the children: open ones go on with the edges of depth ``at``, the others are done."""
    done = F.col("leaf") | (F.col("pos") == F.char_length("word"))
    return met.select("side", "word", "pos", F.concat("node", "piece").alias("node"), (~done).alias("open"),
                      (F.col("depth") + F.col("size")).cast("int").alias("at"))


def _spawned(sides: DataFrame, trie: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """States with one edit where they leave their word's own path, over all levels."""
    own = _at_levels(sides, steps).withColumn("len", F.char_length("word")).where("len >= depth AND len div 2 < depth + size")
    own = own.withColumn("tail", F.expr("substring(word, depth + 1, size + 2)"))  # all that the tests below read of the word
    met = own.join(trie, ["side", "depth", "node"]).withColumn("n", F.char_length("piece")).where("piece != substring(tail, 1, n)")
    kinds = []
    for extra in (0, -1, 1):  # replaced, extra in the neighbour, missing in the neighbour
        # as in _alive: a word of that length lies there, and both are at their end or the next code point may follow
        after = f"substring(tail, n + {extra} + 1, 1)"
        alive = (f"len >= depth + n + {extra} AND {_has('lengths', f'least(len - {extra}, 63)')} AND "
                 f"if(len = depth + n + {extra}, ends, {_has('follows', f'ascii({after}) % 64')})")
        # a piece of one code point: another one, one against none, or the second of two
        single = "piece = substring(tail, 2, 1)" if extra == 1 else "true"
        one = f"if(size = 1, {single}, levenshtein(piece, substring(tail, 1, n + {extra}), 1) = 1)"
        kinds.append(F.expr(f"if({alive} AND {one}, depth + n + {extra}, null)"))
    met = met.where(F.coalesce(*kinds).isNotNull())
    return _states(met.withColumn("pos", F.explode(F.array(*kinds))).where("pos IS NOT NULL"))


def _followed(frontier: DataFrame, trie: DataFrame, depth: int, size: int) -> DataFrame:
    """Open states at ``depth``, one exact piece further."""
    ahead = frontier.select("side", "word", "pos", "node", _piece("word", F.col("pos"), size).alias("piece"))
    met = ahead.join(trie.where(F.col("depth") == depth), ["side", "node", "piece"]).where(_alive("(pos + char_length(piece))"))
    return _states(met.withColumn("pos", F.col("pos") + F.char_length("piece")).withColumn("size", F.lit(size)))


def _ended(states: DataFrame) -> DataFrame:
    """(side, word, near): what the states that are done would have to end in."""
    return states.where("NOT open").select("side", "word", F.expr("concat(node, substring(word, pos + 1))").alias("near"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near), both ways, for words that differ by exactly one inserted, deleted or replaced code point.
    ``words`` is a written table."""
    lengths = words.agg(F.min(F.char_length("word")), F.max(F.char_length("word"))).first()
    steps = levels(lengths[0] or 0, lengths[1] or 0)
    if not steps:
        return written(words.select("word", F.col("word").alias("near")), "near")
    sides = written(words.select(F.lit(0).alias("side"), "word").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word"))), "sides")
    trie = written(edges(sides, steps), "trie", "depth")
    spawned = written(_spawned(sides, trie, steps), "frontier", "at")
    waiting = {r["at"] for r in spawned.where("open").select("at").distinct().collect()}  # at most one row a level
    # one code point less at the end is no edge of the trie
    ends = sides.select("side", "word", F.expr("substring(word, 1, char_length(word) - 1)").alias("near"))
    found, tables, frontier = [ends, _ended(spawned)], [sides, trie, spawned], None
    for depth, size in steps:
        starts = [spawned.where((F.col("at") == depth) & F.col("open"))] if depth in waiting else []
        if frontier is not None:
            starts.append(frontier.where("open"))
        if not starts:
            continue
        left = Observation()
        reached = _followed(reduce(DataFrame.unionByName, [s.select("side", "word", "pos", "node") for s in starts]), trie, depth, size)
        reached = written(reached.observe(left, F.count_if("open").alias("open")), "frontier")
        found.append(_ended(reached))
        tables.append(reached)
        frontier = reached if left.get["open"] else None
    turned = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    # an edit inside a run of one code point may lie in either half
    near = reduce(DataFrame.unionByName, found).select(turned("word"), turned("near")).distinct()
    out = written(near.join(words.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near"), "near")
    discard(*tables)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form; ``forms``: (word, form), acyclic."""
    pointer = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = pointer.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(pointer.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(pointer)
        pointer = after
        if pointer.where("moved").isEmpty():
            return pointer.select("word", "root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = written(vocabulary(docs, id_col, text_col), "words")
    near = neighbours(words)
    known = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    form = -F.col("best.down") >= 2 * F.col("n")
    judged = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"),
        F.when(form, -F.col("best.down")).alias("form_n")), "forms")
    discard(near)
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
