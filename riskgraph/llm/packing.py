"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Documents longer than the capacity are cut into full pieces (a shorter piece comes first); every other
document is one piece.  Only the histogram of piece lengths decides how sequences are filled, and it has
at most ``capacity`` entries whatever the corpus size.  On it, bins are filled one kind at a time: the
longest length left is fixed, a bitset subset-sum program over the lengths left (each with its count)
finds the fullest combination that goes with it, and that combination is taken as many times as
the counts allow before it is removed.  Every kind uses up some length to below what it takes, so there
are O(capacity log capacity) kinds.

Pieces then get numbers within their length and look up their slot.  Numbering is spread: a length
with many pieces (a third of the corpus may be copies of one document) is dealt to salted groups of about
``GROUP`` pieces, numbered there, and shifted by the running sum of the group sizes.

Defined results: null text counts as empty (one piece, the end id alone); repeated rows are packed each
on its own; ties among equal lengths go by doc_id; an empty table gives no rows; further columns of the
input are not carried.  Token ids are made text by text in Arrow batches and only digests (or, if asked
for, the ids) are kept.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.byte_bpe import PieceTable, encode_groups, texts_of
from riskgraph.llm.tables import written

CAPACITY = 2048
END_ID = 0
GROUP = 2000


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level BPE file whose ids are in the order of its merges, so that merging by the smallest id
    gives the file's own ids; None for any other file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model.get("vocab"), [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain:
        return None
    # the usual printable stand-ins for bytes
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    merged = [vocab.get(a + b, -1) for a, b in merges]
    single = [t for t in byte_of if t in vocab]
    if len(single) < 256 or merged != sorted(set(merged)) or merged[0] < 256 or len(vocab) != 256 + len(merges):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


class TokenizerIds:
    """Ids of whole texts as the tokenizer file gives them; splitting is vectorised and each distinct piece is encoded
    once while it stays in the table: by merging over the file's own ranks where its ids are in the order of its merges,
    else by the library.  Texts that hold the string of an added token are encoded by the library as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks := byte_ranks(path):
            import tiktoken

            merger = tiktoken.Encoding("pieces", pat_str="(?s:.)+", mergeable_ranks=ranks, special_tokens={})
            self.table = PieceTable(lambda words: [merger.encode_ordinary(w) for w in words])
        else:
            self.table = PieceTable(lambda words: [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        special = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        plain = ((ids, bounds) for ids, bounds in encode_groups([t for i, t in enumerate(texts) if i not in special], self.table))
        flow = (ids[i:j] for ids, bounds in plain for i, j in zip(bounds.tolist(), bounds[1:].tolist()))
        for i, text in enumerate(texts):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32) if i in special else next(flow)


_tokenizers: dict[str, TokenizerIds] = {}


def tokenizer_ids(path: str) -> TokenizerIds:
    if path not in _tokenizers:
        _tokenizers[path] = TokenizerIds(path)
    return _tokenizers[path]


def cuts(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: full ones, a shorter one first."""
    start, size = 0, total % capacity or capacity
    while start < total:
        yield start, size
        start, size = start + size, capacity


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encoder = tokenizer_ids(path)
        for b in batches:
            done = 0
            for texts in texts_of(b.column(1)):
                rows = []
                for doc, ids in zip(b.column(0).slice(done, len(texts)).to_pylist(), encoder.encode_batch(texts)):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for k, (start, size) in enumerate(cuts(len(ids), capacity)):
                        own = ids[start:start + size]
                        rows.append((doc, k, start, size, zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
                done += len(texts)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def fullest(counts: np.ndarray, space: int) -> list[int]:
    """Lengths, with repeats, of the combination that comes nearest to ``space`` from below, taking no
    length more often than counted; of equally full ones that with the longest pieces, so that short
    pieces stay for later bins.  Sums reachable so far are the bits of one integer; lengths are entered
    from the shortest, and the combination is read back from the longest."""
    reach, mask = 1, (1 << (space + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in np.flatnonzero(counts[:space + 1]).tolist():
        left = min(int(counts[length]), space // length)
        take = 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if total >= length * take and before >> (total - length * take) & 1:
            out += [length] * take
            total -= length * take
    return out


def bin_kinds(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in one bin, longest first; how many such bins) by minimum bin slack."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            lengths = [longest, *fullest(counts, capacity - longest)]
            counts[longest] += 1
            used, each = np.unique(lengths, return_counts=True)
            times = int((counts[used] // each).min())
            counts[used] -= each * times
            out.append((sorted(lengths, reverse=True), times))
    return out


class Slots:
    """Where the i-th piece of a length goes: one interval of numbers per kind of bin and length."""

    def __init__(self, kinds: list[tuple[list[int], int]]):
        rows, given, first_bin = [], {}, 0
        for lengths, times in kinds:
            offset = 0
            for length in dict.fromkeys(lengths):
                each = lengths.count(length)
                low = given.get(length, 0)
                rows.append((length, low, each, first_bin, offset))
                given[length] = low + each * times
                offset += length * each
            first_bin += times
        rows.sort()
        self.length, self.low, self.each, self.bin, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
        self.key = (self.length << 48) | self.low

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces numbered within their length from 0."""
        at = np.searchsorted(self.key, (length << 48) | number, side="right") - 1
        rank = number - self.low[at]
        return self.bin[at] + rank // self.each[at], self.offset[at] + rank % self.each[at] * length


def numbered(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within each length.  ``sizes``: (length, n), at most capacity rows."""
    groups = F.broadcast(sizes.select("length", F.ceil(F.col("n") / GROUP).alias("groups")))
    salted = pieces.join(groups, "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(7)), F.col("groups"))).drop("groups")
    salted = written(salted, "salted_pieces")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(shift, ["length", "salt"]).withColumn("number", F.col("rank") + F.col("shift")).drop("rank", "shift", "salt")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length, ids_crc32) with sequence_id and offset."""
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.collect()}  # at most ``capacity`` rows
    slots = pieces.sparkSession.sparkContext.broadcast(Slots(bin_kinds(histogram, capacity)))
    known = pieces.sparkSession.createDataFrame(list(histogram.items()) or [], "length long, n long")
    rows = numbered(pieces, known)
    columns = [c for c in pieces.columns]
    schema = pieces.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches):
        for b in batches:
            where = {n: i for i, n in enumerate(b.schema.names)}
            bins, offsets = slots.value(*(b.column(where[c]).to_numpy() for c in ("length", "number")))
            yield pa.RecordBatch.from_arrays([*(b.column(where[c]) for c in columns), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=[*columns, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece of every document."""
    return pack(written(token_pieces(docs, path, capacity, with_ids), "token_pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the whole sequence), doc_ids, from pieces packed with ids.  A group holds at most
    ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
