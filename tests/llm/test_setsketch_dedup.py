import random
import re

import numpy as np
import pytest

from riskgraph.llm import queries, setsketch_dedup as S
from tests.llm.helpers import DOC_SCHEMA, SF, awkward_docs, awkward_texts, no_docs, rows


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return set()
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)}


def brute(docs):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    where = {}
    for i, s in enumerate(sets):
        near = {j for sh in s for j in where.get(sh, ())}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= 85 * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
        for sh in s:
            where.setdefault(sh, []).append(i)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        comp = low.get(root(i))
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_query_matches_brute_force(spark):
    assert got(queries.QUERIES["op13_setsketch_dedup"](spark, SF)) == brute(rows("documents", "doc_id, text"))


def test_awkward_rows(spark):
    assert got(S.dedup(awkward_docs(spark))) == brute(awkward_texts())


def test_empty_table(spark):
    assert got(S.dedup(no_docs(spark))) == []


def variants(n, words=90, seed=5):
    """Texts around one centre, at similarities about the threshold, the centre itself among them."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = [base]
    for k in range(n - 1):
        t = list(base)
        for at in r.sample(range(words), r.choice([1, 2, 3, 4])):
            t[at] = f"x{k}.{at}"
        out.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_groups_about_the_threshold(spark, monkeypatch):
    """Many near copies whose links to the centre and to each other hold or fail narrowly, in several chunks."""
    monkeypatch.setattr(S, "CHUNK_NODES", 16)
    docs = variants(120) + [(1000 + i, t) for i, t in variants(40, 40, 7)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, "l", 1, 1, 1) for i, t in docs], DOC_SCHEMA)
    assert got(S.dedup(frame)) == brute(docs)


def test_chain_links_through_neighbours(spark):
    words = [f"v{i}" for i in range(400)]
    docs = [(k, " ".join(words[5 * k:5 * k + 120])) for k in range(30)]  # each overlaps the next at 0.92, ends not at all
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, "l", 1, 1, 1) for i, t in docs], DOC_SCHEMA)
    assert {r[2] for r in got(S.dedup(frame))} == {0}


def test_registers_merge_by_maximum():
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(500))
    _, one, _ = S.sketch_texts([a, b])
    both, _, _ = S.sketch_texts([a + " \n " + b])
    assert both[0] == 298 + 498 + 2
    _, whole, _ = S.sketch_texts([a + " \n " + b])
    joint = np.maximum(one[0], one[1])
    assert (whole[0] >= joint).all() and (whole[0] == joint).mean() > 0.95  # two shingles cross the seam


@pytest.mark.parametrize("kept_share", [0.5, 0.8, 0.95])
def test_likelihood_estimates_similarity(kept_share):
    words = [f"w{i}" for i in range(3000)]
    cut = int(3000 * kept_share)
    n, values, _ = S.sketch_texts([" ".join(words), " ".join(words[:cut])])
    best, _ = S.judge_pairs(n[:1], n[1:], (values[:1] > values[1:]).sum(1), (values[:1] < values[1:]).sum(1), S.THRESHOLD)
    assert abs(best[0] - n[1] / n[0]) < 0.1


def test_very_long_text_is_hashed_whole():
    words = [f"w{i % 70000}q{i % 11}" for i in range(900_000)]
    n, values, _ = S.sketch_texts([" ".join(words), " ".join(words).upper()])
    assert n[0] == n[1] == len({tuple(words[i:i + 3]) for i in range(len(words) - 2)})
    assert (values[0] == values[1]).all()
