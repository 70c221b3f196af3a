"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation uses no regular expression.  Code points become class symbols through one
table; look-ahead that the splitting pattern needs (the letters of a contraction, what follows
white space) is folded into the symbols by shifted array comparisons.  A finite automaton over
those symbols then yields "a piece starts here".  Each symbol is a transition function over the
automaton's states; function composition is associative, so a text is cut into equal strips,
all strips are composed at once (vectorised over strips and entry states), the short sequence of
strip functions is scanned, and the strips are replayed from their now known entry states.

The slices between starts are named by hashes and looked up, all at once, in a table of pieces seen before;
what is new feeds the pair merge.  Offsets of pieces (code points) and of
tokens (bytes) are kept, so decoding is a gather over the vocabulary that can be cut at any token.

Defined results: null text counts as empty; an empty text has no tokens; repeated rows are
encoded each on its own; extra columns are carried only if asked for.  Very long texts are
processed in segments cut where a piece certainly starts, so working memory is bounded by the
segment (a text without any such place is one segment).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code point classes
OTHER, LETTER, NUMBER, SPACE, WHITE = 0, 1, 2, 3, 4
# Symbols: the classes, with look-ahead folded in
S_OTHER, S_LETTER, S_NUMBER = 0, 1, 2
S_JOIN = 3        # a space right before something that is not white space
S_WHITE = 4       # white space with more white space, or the end of the text, after it
S_LAST = 5        # any other white space right before something that is not white space
S_APOS2, S_APOS3 = 6, 7  # an apostrophe that begins a contraction of 2 or 3 code points, if a piece starts there
S_RESET = 8       # between two texts
N_SYMBOLS = 9
# States: what the piece that is open takes next
Q_FRESH, Q_LETTER, Q_NUMBER, Q_OTHER, Q_JOIN, Q_WHITE, Q_TAKE1, Q_TAKE2 = range(8)
N_STATES = 8
SEGMENT = 1 << 20  # code points handled at once
STRIPS = 16384
CACHE_LIMIT = 1_000_000  # pieces a worker remembers: about 70 MB


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece) by symbol and state."""
    nxt = np.zeros((N_SYMBOLS, N_STATES), np.uint8)
    new = np.zeros((N_SYMBOLS, N_STATES), bool)
    run_of = {S_OTHER: Q_OTHER, S_LETTER: Q_LETTER, S_NUMBER: Q_NUMBER}
    for q in range(N_STATES):
        for s in range(N_SYMBOLS):
            if s == S_RESET:
                nxt[s, q] = Q_FRESH
            elif q == Q_TAKE2:
                nxt[s, q] = Q_TAKE1
            elif q == Q_TAKE1:
                nxt[s, q] = Q_FRESH
            elif s in run_of:
                nxt[s, q] = run_of[s]
                new[s, q] = q not in (run_of[s], Q_JOIN)
            elif s in (S_APOS2, S_APOS3):
                inside = q in (Q_OTHER, Q_JOIN)  # the run of other characters goes on
                nxt[s, q] = Q_OTHER if inside else (Q_TAKE1 if s == S_APOS2 else Q_TAKE2)
                new[s, q] = not inside
            elif s == S_JOIN:
                nxt[s, q], new[s, q] = Q_JOIN, True
            elif s == S_LAST:
                nxt[s, q], new[s, q] = Q_FRESH, True
            else:  # S_WHITE
                nxt[s, q], new[s, q] = Q_WHITE, q != Q_WHITE
    return nxt, new


_NEXT, _NEW = _automaton()
_NEXT_FLAT, _NEW_FLAT = _NEXT.ravel(), _NEW.ravel()
_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point.  Letters, numbers and white space are those of the tokenizer
    library's own Unicode tables (read off by encoding each code point once), so that a code
    point assigned in a newer Unicode version is treated as the library treats it."""
    global _classes
    if _classes is None:
        import tiktoken

        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        single = {bytes([i]): i for i in range(256)}
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            lib = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            members = bytes(lib.encode_ordinary(every)).decode("utf-8")
            table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
        table[0x20] = SPACE
        _classes = table
    return _classes


def _symbols(cp: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``reset`` are the positions between texts."""
    cls = class_table()[cp]
    sym = np.empty(len(cp) + 3, np.uint8)
    sym[: len(cp)] = cls
    white = np.ones(len(cp) + 1, bool)  # past the end counts as white space
    np.greater_equal(cls, SPACE, out=white[:-1])
    white[reset] = True
    at = np.flatnonzero(cls >= SPACE)
    ends = white[at + 1]
    sym[at] = np.where(ends, S_WHITE, np.where(cls[at] == SPACE, S_JOIN, S_LAST))
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        tail = np.concatenate([cp, np.zeros(3, cp.dtype)])
        tail[reset] = 0
        a, b = tail[at + 1], tail[at + 2]
        two = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        three = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        sym[at[two]] = S_APOS2
        sym[at[three]] = S_APOS3
    sym[reset] = S_RESET
    return sym[: len(cp)]


def piece_starts(cp: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Positions where pieces start.  ``cp``: code points of texts one after another, each
    followed by one filler whose position is in ``reset``."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(STRIPS, max(1, n // 16))
    length = -(-n // width)
    sym = np.full(width * length, S_RESET, np.uint8)
    sym[:n] = _symbols(cp, reset)
    step = np.ascontiguousarray(sym.reshape(width, length).T).astype(np.int32) * N_STATES
    # compose: state reached at the end of each strip from every entry state; once all strips'
    # functions are constant, one entry state stands for all
    reach = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (width, N_STATES))
    for row in step:
        reach = _NEXT_FLAT[row[:, None] + reach]
        if reach.shape[1] > 1 and (reach == reach[:, :1]).all():
            reach = reach[:, :1]
    # scan the strip functions, then replay every strip from its entry state
    entry = np.full(width, Q_FRESH, np.uint8)
    if reach.shape[1] == 1:
        entry[1:] = reach[:-1, 0]
    else:
        q = Q_FRESH
        for i, f in enumerate(reach.tolist()):
            entry[i] = q
            q = f[q]
    state, starts = entry, np.empty((length, width), bool)
    for i, row in enumerate(step):
        at = row + state
        starts[i] = _NEW_FLAT[at]
        state = _NEXT_FLAT[at]
    return np.flatnonzero(starts.T.ravel()[:n])


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts, each cut before a lone space between two words: a piece starts there."""
    start, n = 0, len(text)
    while n - start > 2 * size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = -1
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class Group:
    """Pieces of a few texts: ``text`` holds the texts one after another, each followed by one filler;
    piece i is ``text[a[i]:b[i]]``; the pieces of text j are ``first[j]:first[j + 1]``."""

    def __init__(self, texts: list[str]):
        self.text = "\0".join(texts) + "\0"
        self.cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        reset = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.a = piece_starts(self.cp, reset)
        self.first = np.searchsorted(self.a, np.concatenate([[0], reset + 1]))
        self.b = np.append(self.a[1:], len(self.cp))
        ends = self.first[1:] - 1
        filled = self.first[1:] > self.first[:-1]
        self.b[ends[filled]] = reset[filled]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over the code points of each piece: one by place, one regardless of it."""
        power, inverse = _powers(0, len(self.cp) + 1)
        spread = (self.cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        total = np.zeros((2, len(self.cp) + 1), np.uint64)
        np.cumsum(spread, out=total[1, 1:])
        spread *= power[: len(self.cp)]
        np.cumsum(spread, out=total[0, 1:])
        one = (total[0][self.b] - total[0][self.a]) * inverse[self.a]
        return one ^ (one >> np.uint64(31)), total[1][self.b] - total[1][self.a]


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if which not in _power_tables or len(_power_tables[which][0]) < n:
        base = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[which]
        size = max(n, SEGMENT + 1)
        _power_tables[which] = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)])
            for x in (base, pow(base, -1, 1 << 64)))
    return _power_tables[which]


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``values[start[i]:start[i] + size[i]]`` one after another."""
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return values[shift + np.arange(len(shift))]


class PairMerger:
    """Pair merging of many pieces at once: pieces are rows of a matrix of ids, every round merges
    the lowest-ranked adjacent pair of each row (leftmost among equals) until none is left."""

    LONG = 48
    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r
                 for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.single = single

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def __call__(self, words: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        raw = [w.encode("utf-8") for w in words]
        for i, piece in enumerate(raw):
            if (r := self.ranks.get(piece)) is not None:
                out[i] = (r,)
            elif len(piece) > self.LONG:
                out[i] = tuple(_merge_long(piece, self.ranks))
            else:
                by_size.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for size, which in by_size.items():
            for i, ids in zip(which, self._merge([raw[i] for i in which], size)):
                out[i] = ids
        return out

    def _merge(self, rows: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.array([len(r) for r in rows])
        ids = self.single[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)]
        column = np.arange(width)
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rank[column[:-1] + 1 >= n[:, None]] = self.NONE
        done: list[tuple[int, ...] | None] = [None] * len(rows)
        live = np.arange(len(rows))
        while len(live):
            each = np.arange(len(live))
            at = rank.argmin(axis=1)
            best = rank[each, at]
            stop = best == self.NONE
            if stop.any():
                for i, row, k in zip(live[stop].tolist(), ids[stop].tolist(), n[stop].tolist()):
                    done[i] = tuple(row[:k])
                go = ~stop
                live, ids, rank, n, at, best = live[go], ids[go], rank[go], n[go], at[go], best[go]
                each = np.arange(len(live))
                if not len(live):
                    break
            later = column >= (at + 1)[:, None]  # the merged right side goes; what follows moves up
            ids = np.take_along_axis(ids, np.minimum(column + later, width - 1), axis=1)
            ids[each, at] = best
            rank = np.take_along_axis(rank, np.minimum(column[:-1] + later[:, :-1], width - 2), axis=1)
            n = n - 1
            rank[each, np.maximum(n - 1, 0)] = self.NONE
            follows = at + 1 < n
            rank[each[follows], at[follows]] = self.pair_ranks(best[follows], ids[each[follows], at[follows] + 1])
            precedes = at > 0
            rank[each[precedes], at[precedes] - 1] = self.pair_ranks(ids[each[precedes], at[precedes] - 1], best[precedes])
        return done


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece in near-linear time: neighbours linked, candidate pairs in a heap."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one side has changed since
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, len(parts[h]) + size))
    return [ranks[p] for p in parts if p is not None]


class PieceTable:
    """Ids of pieces seen before, named by two 64-bit sums: a hash table in arrays (open addressing), looked up for all
    pieces of a group at once.  Beyond ``limit`` pieces it starts anew, so memory is bounded; common pieces are soon back."""

    def __init__(self, encode_many: Callable[[list[str]], list[tuple[int, ...]]], limit: int = CACHE_LIMIT):
        self.encode_many, self.limit = encode_many, limit
        self.clear(limit)

    def clear(self, room: int) -> None:
        bits = max(4, (2 * room).bit_length())
        self.shift, self.mask, self.room = np.uint64(64 - bits), (1 << bits) - 1, room
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.start, self.size = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.flat, self.used, self.filled = np.zeros(4 * room, np.int32), 0, 0

    def _slots(self, one: np.ndarray) -> np.ndarray:
        return ((one * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for those not in the table."""
        slot = self._slots(one)
        out = self.entry[slot]
        todo = np.flatnonzero((out >= 0) & ~((self.one[slot] == one) & (self.two[slot] == two)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = slot[todo]
            out[todo] = self.entry[at]
            todo = todo[(out[todo] >= 0) & ~((self.one[at] == one[todo]) & (self.two[at] == two[todo]))]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[tuple[int, ...]]) -> np.ndarray:
        """Enter distinct pieces that are not in the table; their entries."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        new = np.arange(self.used, self.used + len(ids), dtype=np.int32)
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled:self.filled + len(flat)] = flat
        self.start[new] = self.filled + np.cumsum(size) - size
        self.size[new] = size
        self.used, self.filled = self.used + len(ids), self.filled + len(flat)
        slot, todo = self._slots(one), np.arange(len(ids))
        while len(todo):
            at = slot[todo]
            free = self.entry[at] < 0
            self.entry[at[free]] = new[todo[free]]  # of several that want a slot one gets it
            won = self.entry[at] == new[todo]
            self.one[at[won]], self.two[at[won]] = one[todo[won]], two[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask
        return new

    def __call__(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece)."""
        one, two = group.names()
        entry = self.find(one, two)
        missing = np.flatnonzero(entry < 0)
        if len(missing) and self.used + len(missing) > self.room:
            self.clear(max(self.limit, len(one)))
            missing = np.arange(len(one))
        if len(missing):
            order = missing[np.lexsort((two[missing], one[missing]))]
            first = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
            at = order[first]
            words = [group.text[i:j] for i, j in zip(group.a[at].tolist(), group.b[at].tolist())]
            entry[order] = self.add(one[at], two[at], self.encode_many(words))[np.cumsum(first) - 1]
        size = self.size[entry].astype(np.int64)
        return (gather(self.flat, self.start[entry], size) if len(size) else self.flat[:0]), size


def encode_groups(texts: list[str], table: PieceTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, bounds) for groups of texts in order: the ids of a group's text j are
    ``ids[bounds[j]:bounds[j + 1]]``."""
    def run(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
        g = Group(group)
        ids, size = table(g)
        return ids, np.concatenate([[0], np.cumsum(size)])[g.first]

    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > SEGMENT:
            yield run(group)
            group, held = [], 0
        if len(text) > 2 * SEGMENT:
            ids = np.concatenate([run([part])[0] for part in segments(text)])
            yield ids, np.array([0, len(ids)])
            continue
        group.append(text)
        held += len(text)
    if group:
        yield run(group)


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        vocab: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            vocab[rank] = token
        self.bytes, self.start, self.size = self._table(vocab)
        self.number = self._table([b"%d," % i for i in range(len(vocab))])
        self.table = PieceTable(PairMerger(self.ranks))

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids, bounds in encode_groups(texts, self.table):
            for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
                yield ids[i:j]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, and the end."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.start[ids], self.size[ids]).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        table, start, size = self.number
        return gather(table, start[ids], size[ids])[:-1].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and rank file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def texts_of(column: pa.Array, step: int = 256) -> Iterator[list[str]]:
    """A text column as small lists of strings, null as empty."""
    for i in range(0, len(column), step):
        yield [t or "" for t in column.slice(i, step).to_pylist()]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``ids`` (array<int>) and ``offsets`` (array<long>: byte offset of every
    token and the end; ``offsets[i]:offsets[i+1]`` of the UTF-8 text is token i)."""
    schema = docs.select(*keep, F.array(F.lit(0)).alias("ids"), F.array(F.lit(0).cast("long")).alias("offsets")).schema

    def run(batches):
        c = codec(path)
        for b in batches:
            done = 0
            for texts in texts_of(b.column(b.num_columns - 1)):
                rows = [(ids, c.token_offsets(ids)) for ids in c.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(col.slice(done, len(texts)) for col in b.columns[:-1]),
                     pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                    names=[*keep, "ids", "offsets"])
                done += len(texts)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``bytes`` (binary) from column ``ids``; null ids give empty bytes."""
    schema = encoded.select(*keep, F.lit(b"").alias("bytes")).schema

    def run(batches):
        c = codec(path)
        for b in batches:
            out = [c.decode(np.array(ids or [], np.int64)) for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*keep, "bytes"])

    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass: ids are made, hashed, decoded and
    dropped per text, so that no table of ids is written."""
    def run(batches):
        c = codec(path)
        for b in batches:
            done = 0
            for texts in texts_of(b.column(1)):
                n, sha, back = [], [], []
                for ids in c.encode_batch(texts):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(c.decimal(ids)).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(texts)), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
