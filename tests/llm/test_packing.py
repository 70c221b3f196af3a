import bisect
import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from riskgraph.llm import packing, queries

from .helpers import SF, awkward_docs, awkward_texts, no_docs, rows

PATH = P.path("byte_bpe_50k.json")


def check(packed, texts, capacity):
    """Pieces are those of the documents, and sequences are gapless and within the capacity."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(bounds))]
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in packed)


def test_query(spark):
    n, total = check(queries.op5_packing(spark, SF).collect(), rows("documents", "doc_id, text"), 2048)
    assert n <= -(-total // 2048) + 1


def test_awkward_rows(spark):
    check(packing.pack_documents(awkward_docs(spark), PATH, capacity=64).collect(), awkward_texts(), 64)
    assert packing.pack_documents(no_docs(spark), PATH).collect() == []


def test_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(awkward_docs(spark).where("doc_id > 8"), PATH, capacity=128, with_ids=True)
    out = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in out) == sum(r["length"] for r in packed.collect()) and all(len(r["ids"]) <= 128 for r in out)


def test_fullest_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for x in rng.integers(1, 31, 5):
            counts[x] += rng.integers(1, 3)
        lengths = [x for x in range(31) for _ in range(counts[x])]
        best = max(s for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r) if (s := sum(c)) <= 25)
        got = packing.fullest(counts, 25)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_bin_kinds_use_every_piece_once():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(5, 1.2, 20000), 1, 2048).astype(int), return_counts=True))}
    histogram[700] = 9000  # a third of all pieces are copies
    kinds = packing.bin_kinds(histogram)
    used = defaultdict(int)
    for lengths, times in kinds:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == histogram
    free = []  # best-fit decreasing
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(free, length)
        left = (free.pop(at) if at < len(free) else 2048) - length
        bisect.insort(free, left)
    assert sum(t for _, t in kinds) <= len(free)


def test_hot_length_is_numbered_in_small_groups(spark):
    pieces = spark.range(9000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 = 0, 7L, id % 50 + 1) length", "id ids_crc32")
    out = packing.pack(pieces, 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 9000


def test_pieces_by_ranks_equal_the_library():
    """Random byte soup, all scripts: merging by the file's ranks gives the library's ids."""
    import random

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert len(packing.byte_ranks(path)) == 50256 and packing.byte_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    own, r = packing.TokenizerIds(path), random.Random(6)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xC0, 0x250), r.randrange(0x370, 0x5F0), r.randrange(0x4E00, 0x4F00),
                                   r.randrange(0x1F300, 0x1F600), 10, 32, 39])) for _ in range(r.randrange(200))) for _ in range(400)]
    texts += ["a" * 5000, "<|endoftext|> x", "\x00\x01 \u200b", "don't we'LL  \n\n  end "]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
