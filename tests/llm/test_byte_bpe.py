import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from riskgraph.llm import byte_bpe, packing

from .helpers import awkward_docs, awkward_texts, no_docs, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("ab stmdrevl''  \n\t\x0b　  1٣.,!é中😀ᲊ\x1c\0̀") + ["'s", "'re", "'ll", " '"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_match_the_library_and_round_trip(library):
    codec = byte_bpe.codec(PATH)
    texts = random_texts(4000) + [t or "" for _, t in awkward_texts()] + ["", "'", "'s's", "  a \n b  ", "x" * 3000] + [
        t for _, t in rows("documents", "doc_id, text")]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.token_offsets(ids)[-1] == len(text.encode())


def test_segments_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SEGMENT", 64)
    texts = [t for _, t in rows("documents", "doc_id, text")][:60] + random_texts(200) + ["y" * 500]
    for text, ids in zip(texts, byte_bpe.codec(PATH).encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_strip_composition_matches_one_strip(monkeypatch):
    text = "\0".join(random_texts(300, 9)) + "\0"
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    reset = np.flatnonzero(cp == 0)
    whole = byte_bpe.piece_starts(cp, reset)
    monkeypatch.setattr(byte_bpe, "STRIPS", 1)
    assert np.array_equal(whole, byte_bpe.piece_starts(cp, reset))


def test_small_table_keeps_results(library):
    codec = byte_bpe.Codec(PATH)
    codec.table = byte_bpe.PieceTable(codec.table.encode_many, 50)
    texts = random_texts(500, 5)
    assert [i.tolist() for i in codec.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]
    for t in texts[:50]:
        assert next(iter(codec.encode_batch([t]))).tolist() == library.encode_ordinary(t)


def test_digests_of_awkward_rows(spark, library):
    got = sorted(map(tuple, byte_bpe.digests(awkward_docs(spark), PATH).collect()), key=repr)
    want = []
    for i, t in awkward_texts():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert byte_bpe.digests(no_docs(spark), PATH).collect() == []


def test_encode_then_decode(spark):
    encoded = byte_bpe.encode(awkward_docs(spark), PATH, keep=("doc_id", "kept"))
    back = byte_bpe.decode(encoded, PATH).collect()
    assert sorted((bytes(r["bytes"]) for r in back)) == sorted((t or "").encode() for _, t in awkward_texts())
    row = encoded.where("doc_id = 16").first()
    assert row["offsets"][0] == 0 and row["offsets"][-1] == len("password = hunter2secret") and len(row["offsets"]) == len(row["ids"]) + 1


def test_tokenizer_ids_match_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = random_texts(1500, 8) + ["a<|endoftext|>b", "", "  lead"] + [t for _, t in rows("documents", "doc_id, text")][:80]
    tokenizer = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.tokenizer_ids(path).encode_batch(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_small_piece_table_starts_anew():
    """A table far smaller than the number of pieces gives the same ids."""
    import public_tokenizers

    ranks = byte_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    merger = byte_bpe.PairMerger(ranks)
    texts = [" ".join(f"w{(i * j) % 97}x{j % 13}" for j in range(50)) for i in range(60)] + ["", "one"]
    small, large = byte_bpe.PieceTable(merger, 40), byte_bpe.PieceTable(merger)
    for part in (texts, texts[::-1], texts[:3]):
        for (a, b), (c, d) in zip(byte_bpe.encode_groups(part, small), byte_bpe.encode_groups(part, large)):
            assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
    for text in texts:
        assert sum((len(a) for a, _ in byte_bpe.encode_groups([text], small)), 0) == sum((len(a) for a, _ in byte_bpe.encode_groups([text], large)), 0)
