import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskgraph.llm import jaccard_join as J
from riskgraph.llm import queries, shingles
from riskgraph.llm.components import components

from .helpers import awkward_docs, awkward_texts, no_docs, rows

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    """(id, class, links) of every document by comparing all that share a shingle."""
    sets = [shingle_set(t) for _, t in docs]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    links, root = Counter(), list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < k).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[k] += 1
                links[j] += 1
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k)), links[k]) for k, (i, _) in enumerate(docs)), key=repr)


def test_query_matches_brute_force(spark):
    got = sorted(map(tuple, queries.op6_jaccard_join(spark, SF).collect()), key=repr)
    assert got == classes(rows("documents", "doc_id, text", SF))


@pytest.fixture(scope="module")
def family():
    """One text in 700 versions, some linked, some not, many of them copied."""
    rng = random.Random(6)
    first = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(700):
        words = list(first)
        for k in rng.sample(range(120), rng.randrange(5)):
            words[k] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    return docs + [(1000 + i, docs[i][1]) for i in range(0, 700, 3)]


def test_large_group_in_several_chunks(spark, family):
    table = spark.createDataFrame(family, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in J.join(table).collect()), key=repr)
    assert got == classes(family)
    assert sum(links for *_, links in got) > 10000


def test_awkward_rows(spark):
    got = sorted((tuple(r)[:3] for r in J.join(awkward_docs(spark)).collect()), key=repr)
    assert got == classes(awkward_texts())
    assert J.join(no_docs(spark)).collect() == []


def test_posterior_bound():
    least = J.least_matches(40, 0.8, 1e-7)
    rng = np.random.default_rng(8)
    assert least < 32 and (rng.binomial(40, 0.8, 200000) < least).sum() <= 2
    assert J.least_matches(160, 0.8, 1e-7) > 0.6 * 160, "clearly different pairs are dropped"


def test_pruning_keeps_what_matches():
    rng = np.random.default_rng(9)
    u = rng.integers(0, 2**31, (30, 160)).astype(np.int32)
    v = u[::-1].copy()
    v[:, 150:] = 0
    least = {n: J.least_matches(n, 0.8, 1e-7) for n in range(20, 161, 20)}
    assert {tuple(p) for p in J.pruned_pairs(u, v, False, least).tolist()} == {(i, 29 - i) for i in range(30)}


def test_exact_link_at_the_threshold():
    a = np.arange(9, dtype=np.uint64)
    assert J.linked(a, np.arange(1, 10, dtype=np.uint64)) and not J.linked(a, np.arange(2, 11, dtype=np.uint64))
    assert not J.linked(a[:0], a[:0])


def test_long_texts_have_the_same_shingles_in_segments(monkeypatch):
    texts = [t or "" for _, t in awkward_texts()]
    whole, values = shingles.sets(texts), shingles.minhashes(texts, 20)
    assert [len(s) for s in whole] == [len(shingle_set(t)) for t in texts]
    monkeypatch.setattr(shingles, "SEGMENT", 90)
    assert all(np.array_equal(a, b) for a, b in itertools.zip_longest(whole, shingles.sets(texts)))
    assert np.array_equal(values, shingles.minhashes(texts, 20))


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1400), 1000)}
