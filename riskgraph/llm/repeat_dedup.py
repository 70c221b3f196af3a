"""Removal of repeated byte strings by content-defined parsing of the corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else.  Texts are parsed at
rolling-hash triggers, as in prefix-free parsing: the trigger of a string of ``LENGTH`` bytes is the
leftmost smallest hash of a gram in it, so equal strings have the same trigger at the same place, wherever
they stand.  Strings are named by their trigger's position and how far before it they start.

1. Dictionary of triggers.  Grams at triggers are counted over the corpus (about one per 80 bytes).
   Strings whose trigger's gram is unique are unique; most of the corpus ends here.
2. Dictionary of phrases.  Strings of one trigger are taken in phrases of ``BLOCK`` neighbouring starts.
   A phrase has an inner part (common to all its strings) and an outer part (all bytes they cover).
   A unique inner part: no string of the phrase repeats.  A repeated outer part: all of them do.
3. Only phrases whose inner part repeats with different outer parts, which is where repeats begin
   and end, are spelled out string by string; one copy of every different outer part is enough.

Where the textbook method would put phrase suffixes in order, this puts them in equality classes: only "occurs
again" is asked, and classes are plain aggregates that Spark counts by partial sums, whereas an order needs all
suffixes of a hot phrase together and eight or more bytes for every byte of the corpus.

Copies: equal texts are parsed once, and a text that occurs twice goes whole.  Texts are written once as
a table bucketed by text, so each step brings its marks to the texts and no text moves again.

Defined results: null text is empty; texts shorter than ``LENGTH`` keep all bytes; repeated rows are copies
of each other; null ids are carried; extra columns are not.  Very long texts are handled in segments.
Equality is that of two 64-bit hashes together (128 bits) for every string that is removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.byte_bpe import _powers
from riskgraph.llm.shingles import _SPREAD, mix
from riskgraph.llm.tables import adopt, discard, written
from riskgraph.session import scratch_path

LENGTH = 200
GRAM = 32
BLOCK = 32
SEGMENT = 1 << 20
_REACH = LENGTH - GRAM + 1  # gram positions in one string
_PLACE = np.uint64((1 << 22) - 1)
TEXT = ["tid", "chk"]


class Bytes:
    """Hashes of byte ranges of some data, the same wherever the range stands."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(0, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SPREAD[data] * self.power[:len(data)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, also: np.ndarray | int = 0) -> np.ndarray:
        raw = (self.total[end] - self.total[start]) * self.inverse[start]
        return mix(raw + np.asarray(end - start + 1000 * np.asarray(also, np.int64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def batches_of(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(index of the first text, bytes of some texts one after another, their bounds, place of the first byte in its text).
    A long text comes alone, in segments that overlap by ``LENGTH`` - 1."""
    held: list[bytes] = []
    size, at = 0, 0

    def joined():
        return at, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in held])]), 0

    for i, raw in enumerate(raws):
        if held and size + len(raw) > SEGMENT:
            yield joined()
            held, size = [], 0
        if len(raw) > 2 * SEGMENT:
            for start in range(0, len(raw) - LENGTH + 1, SEGMENT):
                part = np.frombuffer(raw, np.uint8, min(SEGMENT + LENGTH - 1, len(raw) - start), start)
                yield i, part, np.array([0, len(part)]), start
            continue
        if not held:
            at = i
        held.append(raw)
        size += len(raw)
    if held:
        yield joined()


def triggers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigger position, first and last start of its strings, gram hash) of all strings; positions in ``data``."""
    n = len(data) - LENGTH + 1
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = len(data) - GRAM + 1
    every = np.arange(grams)
    h = Bytes(data).hash(every, every + GRAM)
    key = np.full(-(-grams // _REACH) * _REACH, np.uint64(2**64 - 1))
    key[:grams] = (h & ~_PLACE) | every.astype(np.uint64)
    rows = key.reshape(-1, _REACH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:n], ahead[_REACH - 1:_REACH - 1 + n]) & _PLACE).astype(np.int64)
    inside = np.flatnonzero(bounds[1:][text[:n]] - np.arange(n) >= LENGTH)
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    own = at[inside]
    new = np.flatnonzero(np.diff(own, prepend=-1))
    low, high = inside[new], inside[np.append(new[1:], len(inside)) - 1]
    return text[low], own[new], low, high, h[own[new]]


def pack_zone(position: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Trigger position and how far before it strings start at most and at least, in one integer."""
    return position << 16 | far << 8 | near


def unpack_zone(ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ref >> 16, ref >> 8 & 255, ref & 255


def phrases(position: np.ndarray, far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of the zone, block, far, near) of every phrase of zones."""
    first, last = near // BLOCK, far // BLOCK
    count = last - first + 1
    zone = np.repeat(np.arange(len(position)), count)
    block = np.arange(len(zone)) - np.repeat(np.cumsum(count) - count, count) + first[zone]
    return zone, block, np.minimum(far[zone], block * BLOCK + BLOCK - 1), np.maximum(near[zone], block * BLOCK)


def _slices(refs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted references by stretches of the text of at most ``SEGMENT`` bytes."""
    if size <= 2 * SEGMENT:
        yield refs
        return
    part = (refs >> 16) // SEGMENT
    for p in np.unique(part):
        yield refs[part == p]


def _merged(refs: np.ndarray) -> np.ndarray:
    """Sorted, one zone per trigger (a zone cut by a segment's end comes in two parts)."""
    position, far, near = unpack_zone(np.sort(refs))
    first = np.flatnonzero(np.diff(position, prepend=-1))
    return pack_zone(position[first], np.maximum.reduceat(far, first), np.minimum.reduceat(near, first))


def _around(raw: bytes, position: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes of a text around these trigger positions, and where they begin."""
    low = max(0, int(position.min()) - 2 * LENGTH)
    high = min(len(raw), int(position.max()) + 2 * LENGTH)
    return np.frombuffer(raw, np.uint8, high - low, low), low


def _arrow(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c if len(c) else [], kinds[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def _stacked(parts: list[tuple], width: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) for i in range(width)] if parts else [np.zeros(0, np.int64)] * width


TRIGGER_ROWS = "tid long, chk int, ref long, gram long"
PHRASE_ROWS = "tid long, chk int, ref long, inner long, outer long"
STRING_ROWS = "tid long, chk int, start long, inner long, whole long"


def _rows(batch: pa.RecordBatch, step: int = 128):
    for i in range(0, len(batch), step):
        part = batch.slice(i, step)
        yield [part.column(k) for k in range(part.num_columns)]


def _trigger_rows(batches):
    for b in batches:
        for tid, chk, text in _rows(b):
            tid, chk = tid.to_numpy(), chk.to_numpy()
            out = []
            for first, data, bounds, base in batches_of([t.encode("utf-8") for t in text.to_pylist()]):
                own, position, low, high, gram = triggers(data, bounds)
                ref = pack_zone(position - bounds[own] + base, position - low, position - high)
                out.append((tid[own + first], chk[own + first], ref, gram.view(np.int64)))
            yield _arrow(TRIGGER_ROWS, _stacked(out, 4))


def _phrase_rows(batches):
    for b in batches:
        for tid, chk, text, refs in _rows(b):
            out = []
            for t, c, source, own in zip(tid.to_pylist(), chk.to_pylist(), text.to_pylist(), refs):
                raw = source.encode("utf-8")
                for part in _slices(_merged(own.values.to_numpy()), len(raw)):
                    position, far, near = unpack_zone(part)
                    data, low = _around(raw, position)
                    zone, block, far, near = phrases(position, far, near)
                    h, p = Bytes(data), position[zone] - low
                    inner = h.hash(p - block * BLOCK, p - (block + 1) * BLOCK + 1 + LENGTH, block)
                    start, end = p - (block + 1) * BLOCK + 1, p - block * BLOCK + LENGTH
                    a, e = np.maximum(start, 0), np.minimum(end, len(data))  # data ends where the text does, or far beyond
                    outer = h.hash(a, e, block + 8 * (a - start) + 4096 * (end - e))
                    n = len(p)
                    out.append((np.full(n, t), np.full(n, c), pack_zone(position[zone], far, near), inner.view(np.int64), outer.view(np.int64)))
            yield _arrow(PHRASE_ROWS, _stacked(out, 5))


def _string_rows(batches):
    for b in batches:
        for tid, chk, text, marks in _rows(b):
            out = []
            for t, c, source, own in zip(tid.to_pylist(), chk.to_pylist(), text.to_pylist(), marks):
                raw = source.encode("utf-8")
                refs, inner = own.values.field("ref").to_numpy(), own.values.field("inner").to_numpy()
                order = np.argsort(refs, kind="stable")
                refs, inner = refs[order], inner[order]
                done = 0
                for part in _slices(refs, len(raw)):
                    position, far, near = unpack_zone(part)
                    data, low = _around(raw, position)
                    count = far - near + 1
                    phrase = np.repeat(np.arange(len(part)), count)
                    start = position[phrase] - far[phrase] + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
                    whole = Bytes(data).hash(start - low, start - low + LENGTH)
                    out.append((np.full(len(start), t), np.full(len(start), c), start, inner[done:done + len(part)][phrase], whole.view(np.int64)))
                    done += len(part)
            yield _arrow(STRING_ROWS, _stacked(out, 5))


def covered(n: int, copies: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes, given ranges that overlap in any way."""
    if copies > 1 and n >= LENGTH:
        return [(0, n)]
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist()))


def _runs(raw: bytes, copies: int, zones, starts) -> list[tuple[int, int]]:
    position, far, near = unpack_zone(np.array(zones or [], np.int64))
    single = np.array(starts or [], np.int64)
    return covered(len(raw), copies, np.concatenate([position - far, single]), np.concatenate([position - near, single]) + LENGTH)


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


class Corpus:
    """Different texts as a table bucketed by text (tid, chk, copies, text)."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"texts_{uuid.uuid4().hex}"
        texts = rows.groupBy(*TEXT).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        path = scratch_path(spark, "repeat_texts")
        texts.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, *TEXT).saveAsTable(self.name)
        self.texts = adopt(spark.table(self.name), path)

    def with_marks(self, marks: DataFrame, how: str = "inner") -> DataFrame:
        """Texts with a column of their marks; the marks travel, and are hashed in memory per bucket."""
        return self.texts.join(marks.hint("shuffle_hash"), TEXT, how)

    def discard(self) -> None:
        self.texts.sparkSession.sql(f"DROP TABLE {self.name}")
        discard(self.texts)


def repeated_ranges(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """((tid, chk, zones): phrases all of whose strings repeat; (tid, chk, starts): single strings that repeat)."""
    found = written(corpus.texts.where(F.octet_length("text") >= LENGTH).select(*TEXT, "text").mapInArrow(_trigger_rows, TRIGGER_ROWS), "triggers")
    again = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated_grams")
    zones = found.join(again, "gram").groupBy(*TEXT).agg(F.collect_list("ref").alias("refs"))
    zones = written(zones, "trigger_zones")
    discard(found, again)
    phrase = written(corpus.with_marks(zones).select(*TEXT, "text", "refs").mapInArrow(_phrase_rows, PHRASE_ROWS), "phrases")
    kinds = phrase.groupBy("inner", "outer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*TEXT, "ref")).alias("one"))
    every = written(kinds, "phrase_kinds")
    discard(zones)
    inner = every.groupBy("inner").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("outers")).where("total > 1")
    kinds = written(every.join(inner, "inner").select("inner", "outer", (F.col("n") > 1).alias("full"), (F.col("outers") > 1).alias("mixed"), "one"),
                        "repeated_kinds")
    met = phrase.join(kinds, ["inner", "outer"])
    spelled = F.col("mixed") & (~F.col("full") | (F.struct(*TEXT, "ref") == F.col("one")))
    met = written(met.select(*TEXT, "ref", "inner", "full", spelled.alias("spelled")).where("full or spelled"), "phrase_marks")
    discard(phrase, every, kinds)
    full = written(met.where("full").groupBy(*TEXT).agg(F.collect_list("ref").alias("zones")), "full_phrases")
    open_ = written(met.where("spelled").groupBy(*TEXT).agg(F.collect_list(F.struct("ref", "inner")).alias("marks")), "open_phrases")
    strings = written(corpus.with_marks(open_).select(*TEXT, "text", "marks").mapInArrow(_string_rows, STRING_ROWS), "strings")
    twice = written(strings.groupBy("inner", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated_strings")
    single = written(strings.join(twice, ["inner", "whole"]).groupBy(*TEXT).agg(F.collect_list("start").alias("starts")), "string_marks")
    discard(met, open_, strings, twice)
    return full, single


def cut(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_text: bool = False) -> DataFrame:
    """row (a struct of the columns ``carry``, so that no name clashes), n_bytes, n_removed, n_spans, kept_sha256, spans (array
    of (start, end) in bytes) and, if asked for, kept_text (kept bytes as text; a character cut by a removal is dropped)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("row"), text.alias("text")).select(
        "row", F.xxhash64("text").alias("tid"), F.hash("text").alias("chk"), "text")
    corpus = Corpus(rows.select(*TEXT, "text"))
    full, single = repeated_ranges(corpus)
    marks = written(full.join(single, TEXT, "full"), "marks")
    schema = ("tid long, chk int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<start:bigint,end:bigint>>" + (", kept_text string" if with_text else ""))

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for tid, chk, copies, source, zones, starts in _rows(b):
                out = []
                for c, t, z, s in zip(copies.to_pylist(), source.to_pylist(), zones.to_pylist(), starts.to_pylist()):
                    raw = t.encode("utf-8")
                    runs = _runs(raw, c, z, s)
                    kept = kept_bytes(raw, runs)
                    out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                                [{"start": a, "end": e} for a, e in runs], *([kept.decode("utf-8", "ignore")] if with_text else [])))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
                yield pa.RecordBatch.from_arrays([tid, chk, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                                                 names=["tid", "chk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept_text"] * with_text)

    result = corpus.with_marks(marks, "left").select(*TEXT, "copies", "text", "zones", "starts").mapInArrow(run, schema)
    result = written(result, "deduplicated")
    discard(full, single, marks)
    corpus.discard()
    return rows.select("row", *TEXT).join(result, TEXT).select("row", *result.columns[2:])


def dedup(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_text: bool = False) -> DataFrame:
    """:func:`cut` with the carried columns beside the others."""
    found = cut(docs, carry, text_col, with_text)
    return found.select("row.*", *found.columns[1:])
