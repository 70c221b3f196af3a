import random
from decimal import Decimal
from math import floor, isfinite

import numpy as np
import pytest

from riskgraph.llm import queries, whitening as W
from tests.llm.helpers import SF, rows

SCHEMA = "vec_id long, embedding array<double>, label int, x int, d string, n long, w int, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "d", 3, 4, "c") for i, v in vectors], SCHEMA)


def brute(vectors, count=4):
    """(n, {id: deviation}, eigenvalues over trace, whitened) with whole numbers and numpy."""
    whole = [(i, tuple(floor(256 * float(c)) + 0 for c in v)) for i, v in vectors]
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = values.sum()
    out = {}
    for i, x in whole:
        away = [n * c - t for c, t in zip(x, s)]
        out.setdefault(i, []).append((sum(a * a for a in away), np.array(away, float) / n @ axes[:, :count] / np.sqrt(values[:count])))
    return n, out, values[:count] / trace


def agrees(result, vectors, count=4, tolerance=1e-6):
    n, want, share = brute(vectors, count)
    found = {}
    for r in result:
        assert r.n == n and r.deviation == r.deviation_exact == want[r.vec_id][0][0]
        assert abs(r.explained - share[r.component - 1]) < 1e-4 * share[r.component - 1]
        assert 0 <= r.identity_error < 1e-4
        found.setdefault(r.component, []).append((r.whitened, want[r.vec_id][0][1][r.component - 1]))
    for pairs in found.values():
        got, expected = np.array(pairs).T
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < tolerance  # one sign for all rows
    assert sorted(found) == list(range(1, count + 1))


def test_query_matches_numpy(spark):
    result = queries.QUERIES["op11_whitening"](spark, SF).collect()
    vectors = [(i, v) for i, v in rows("embeddings", "vec_id, embedding") if v is not None and all(c is not None and isfinite(c) for c in v)]
    assert len(result) == 4 * len(vectors)
    agrees(result, vectors)


def clouds(n, d, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * (1 + 3 * (k == 0) + 1.5 * (k == 1)) + r.gauss(0, .1) * k for k in range(d)]) for i in range(n)]


def test_repeated_null_and_broken_rows(spark):
    good = clouds(200, 7, 1)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [1.0] * 6 + [None]), (902, [nan] + [0.0] * 6), (903, [inf] + [0.0] * 6), (904, []), (905, [1e300] * 7), (906, [1.0, 2.0])]
    twice = good + [(500 + i, v) for i, v in good[:50]] + [good[3], (77000, [-0.0] * 7), (77001, [0.0] * 7)]
    result = W.whiten(frame(spark, twice + bad)).collect()
    assert len(result) == 4 * len(twice)
    agrees(result, twice)
    assert W.whiten(frame(spark, twice + bad)).where("vec_id = 77000").drop("vec_id").collect() == (
        W.whiten(frame(spark, twice + bad)).where("vec_id = 77001").drop("vec_id").collect())


def test_null_ids_and_large_entries(spark):
    big = [(i, [c * 1e13 for c in v]) for i, v in clouds(60, 3, 2)]
    result = W.whiten(frame(spark, big)).collect()
    _, want, share = brute(big, 3)
    assert len(result) == 180
    for r in result:
        exact = want[r.vec_id][0][0]
        assert r.deviation_exact == (Decimal(exact) if exact < 10**38 else None)
        assert r.deviation == (exact if exact < 2**63 else None)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-4 and r.identity_error < 1e-4
    assert {r.vec_id for r in W.whiten(frame(spark, [(None, v) for _, v in clouds(20, 3, 2)])).collect()} == {None}


def test_equal_eigenvalues_and_low_rank(spark):
    corners = [(k, [float(s * (a == b)) for b in range(5)]) for k, (a, s) in enumerate((a, s) for a in range(3) for s in (-1, 1))]
    result = W.whiten(frame(spark, corners)).collect()
    assert len(result) == 6 * 3  # rank 3, all eigenvalues equal
    assert all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-9 for r in result)
    white = np.zeros((6, 3))
    for r in result:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 6 - np.eye(3)).max() < 1e-12


def test_nearly_equal_eigenvalues(spark):
    far = [(k, [float(s * (a == b)) * (1e9 if a else 1e9 + 1) for b in range(3)]) for k, (a, s) in enumerate((a, s) for a in range(3) for s in (-1, 1))]
    result = [r for r in W.whiten(frame(spark, far)).collect() if r.component == 1]
    assert all(abs(abs(r.whitened) - (3**.5 if r.vec_id in (0, 1) else 0)) < 1e-12 for r in result)  # a gap of 2e-9


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, vectors):
    out = W.whiten(frame(spark, vectors))
    assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]


def test_polynomial_is_exact(spark):
    r = random.Random(9)
    g = [[r.randint(-10**6, 10**6) for _ in range(6)] for _ in range(6)]
    m = [[sum(a * b for a, b in zip(x, y)) for y in g] for x in g]
    poly = W.characteristic_polynomial(spark, m)

    def det(a):
        return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([row[:j] + row[j + 1:] for row in a[1:]]) for j in range(len(a)))

    for x in (0, 1, -3, 10**7):
        assert sum(c * x**k for k, c in enumerate(poly)) == det([[x * (i == j) - m[i][j] for j in range(6)] for i in range(6)])
    found = [float((a + b) / 2 / 2**s) for a, b, s in W.largest_roots(poly, 6)]
    assert np.allclose(found, np.linalg.eigvalsh(np.array(m, float))[::-1], rtol=1e-6)
