import hashlib
import random
from collections import Counter

import numpy as np

from riskgraph.llm import queries, repeat_dedup as R

from .helpers import awkward_docs, awkward_texts, no_docs, rows

SF = "/root/testdata/sf0.01"


def brute(docs, length=R.LENGTH):
    raws = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone, end = bytearray(len(r)), 0
        for k in range(len(r) - length + 1):
            if count[r[k:k + length]] > 1:
                for j in range(max(k, end), k + length):
                    gone[j] = 1
                end = k + length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for j in range(len(r)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_query_matches_brute_force(spark):
    got = result(queries.op7_repeat_dedup(spark, SF))
    assert got == brute(rows("documents", "doc_id, text", SF)) and sum(r[2] for r in got) > 10000


def planted():
    """Passages shared at odd places: overlapping, at both ends, within one text, one byte short, periodic, many bytes a character."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))
    a, b, c = noise(200), noise(450), noise(199)
    wide = "é中😀ü" * 40
    texts = [a, noise(50) + a, noise(30) + b[:300] + noise(99), b[100:], c + "x", c + "y", noise(500), "ab" * 150, "z" * 199, "z" * 200, "y" * 201,
             wide, "q" + wide + noise(20), noise(100) + a + b + noise(3), a[:150] + b[:250], noise(210) * 2]
    texts += [noise(rng.randrange(300)) + b[50:50 + rng.randrange(150, 400)] + noise(rng.randrange(300)) for _ in range(120)]
    return list(enumerate(texts))


def test_planted_passages(spark):
    docs = planted()
    assert result(R.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_awkward_rows(spark):
    got = R.dedup(awkward_docs(spark), with_text=True)
    assert result(got) == brute(awkward_texts())
    assert all(len(r["kept_text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got.collect())
    assert R.dedup(no_docs(spark)).collect() == []


def test_kept_text_and_carried_columns(spark):
    docs = spark.createDataFrame([(k, t, f"c{k}") for k, t in planted()], "doc_id long, text string, tid string")
    out = R.dedup(docs, carry=("tid", "doc_id"), with_text=True).collect()
    for r in out:
        raw = dict(planted())[r["doc_id"]].encode()
        kept = R.kept_bytes(raw, [(s["start"], s["end"]) for s in r["spans"]])
        assert r["tid"] == f"c{r['doc_id']}" and r["kept_text"] == kept.decode("utf-8", "ignore")


def zones(raws):
    out = set()
    for first, data, bounds, base in R.batches_of(raws):
        own, position, low, high, gram = R.triggers(data, bounds)
        for o, p, a, b, g in zip(own.tolist(), position.tolist(), low.tolist(), high.tolist(), gram.tolist()):
            shift = base - int(bounds[o])
            out |= {(first + o, s + shift, p + shift, g) for s in range(a, b + 1)}
    return out


def test_every_string_has_one_trigger_in_any_segmentation(monkeypatch):
    raws = [t.encode() for _, t in planted()] + ["".join(t for _, t in planted()).encode()]
    whole = zones(raws)
    assert {(i, s) for i, s, _, _ in whole} == {(i, s) for i, r in enumerate(raws) for s in range(len(r) - R.LENGTH + 1)}
    assert len(whole) == sum(max(0, len(r) - R.LENGTH + 1) for r in raws)
    by_string = {}
    for i, s, p, g in whole:
        assert by_string.setdefault(raws[i][s:s + R.LENGTH], (p - s, g)) == (p - s, g), "equal strings, equal trigger"
    monkeypatch.setattr(R, "SEGMENT", 700)
    assert zones(raws) == whole


def test_zone_parts_merge_and_phrases_tile():
    ref = R.pack_zone(np.array([500, 500, 900]), np.array([168, 99, 40]), np.array([100, 3, 0]))
    position, far, near = R.unpack_zone(R._merged(ref))
    assert list(zip(position.tolist(), far.tolist(), near.tolist())) == [(500, 168, 3), (900, 40, 0)]
    zone, block, far, near = R.phrases(position, far, near)
    seen = [(z, a) for z, b, f, n in zip(zone, block, far, near) for a in range(n, f + 1) if a // R.BLOCK == b]
    assert sorted(seen) == [(0, a) for a in range(3, 169)] + [(1, a) for a in range(41)]
