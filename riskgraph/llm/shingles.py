"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts.

Words are runs of bytes other than ASCII white space.  A word's hash is a polynomial over its bytes
(one prefix sum for all texts at once), a shingle's hash mixes the hashes of its words in order.  A text
with fewer words than a shingle takes has one shingle of all its words; without words it has none.
Very long texts are handled in segments that overlap by one word less than a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from riskgraph.llm.byte_bpe import _powers

SIZE = 5
SEGMENT = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPREAD = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text and the number of words)."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    a, b = edge[::2], edge[1::2]
    power, inverse = _powers(0, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SPREAD[data] * power[:len(data)], out=total[1:])
    h = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return h, np.concatenate([[0], np.searchsorted(a, ends)])


def _shingles(words: np.ndarray, first: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text and the number of shingles)."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], count)
    left = np.repeat(first[1:], count) - at  # words from here to the text's end
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[at + k], np.uint64(k + 1)))
    return h, out_first


def _segments(raw: bytes, size: int = SIZE) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > 2 * SEGMENT:
        cut = start + SEGMENT
        while cut < len(raw) and not _SPACE[raw[cut]]:
            cut += 1
        yield raw[start:cut]
        back, words = cut, 0  # the next segment repeats the last words
        while back > start and words < size - 1:
            while back > start and _SPACE[raw[back - 1]]:
                back -= 1
            while back > start and not _SPACE[raw[back - 1]]:
                back -= 1
            words += 1
        start = back if back > start else cut
    yield raw[start:]


def grouped(texts: list[str], size: int = SIZE, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, shingle hashes, bounds) for runs of texts; a long text comes alone.
    ``fold`` reads A-Z as a-z."""
    def run(at: int, raws: list[bytes]):
        return at, *_shingles(*_words(raws), size)

    held: list[bytes] = []
    held_bytes, at = 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8")
        raw = raw.lower() if fold else raw
        if held and held_bytes + len(raw) > SEGMENT:
            yield run(at, held)
            held, held_bytes = [], 0
        if len(raw) > 2 * SEGMENT:
            h = np.unique(np.concatenate([run(0, [s])[1] for s in _segments(raw, size)]))
            yield i, h, np.array([0, len(h)])
            continue
        if not held:
            at = i
        held.append(raw)
        held_bytes += len(raw)
    if held:
        yield run(at, held)


def sets(texts: list[str], size: int = SIZE, fold: bool = False) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, h, first in grouped(texts, size, fold):
        out += [np.unique(h[i:j]) for i, j in zip(first.tolist(), first[1:].tolist())]
    return out


def minhashes(texts: list[str], n: int) -> np.ndarray:
    """n MinHash values (uint32) of each text's shingle set; all ones without shingles."""
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = np.full((len(texts), n), 0xFFFFFFFF, np.uint32)
    for at, h, first in grouped(texts):
        filled = np.flatnonzero(np.diff(first))
        if len(filled):
            starts, rows = first[filled], at + filled
            for k in range(n):
                out[rows, k] = np.minimum.reduceat(((h ^ offset[k]) * factor[k]) >> np.uint64(32), starts)
    return out
