"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

1. Every entry becomes floor(256 * c); the fit list holds each distinct integer vector once.  Its sums and products are
   whole numbers, summed per partition and added up as limbs of 40 bits, so nothing is rounded: M = n * sum(x x') - S S'
   is n^2 times the covariance.
2. The characteristic polynomial of M modulo many 31-bit primes: reduction to Hessenberg form and its recurrence, for a
   batch of primes at once, the batches dealt to Spark's tasks.  Chinese remaindering gives the integer coefficients; as M
   has no negative eigenvalue, coefficient k is at most C(d, k) (trace / d)^k, which fixes how many primes are needed.
3. All roots are real, so the sign changes of the polynomial moved to a point count the roots above it exactly.
   Bisection with exact integers isolates the largest roots and narrows them to a relative 2^-208.
4. Components come from inverse iteration on M - root I in decimals of 90 digits.  Roots that stay together within that
   width are one eigenspace: later components of it are made orthogonal to earlier ones.
5. Vectors are projected in blocks; the covariance of the whitened fit list is measured (centred aggregates).

The driver holds tables of the dimension's size only (products, coefficients, components), none that grows with rows.

Defined results: vectors that are null, empty or hold a null, a non-finite entry or one whose integer is no long are dropped;
of different lengths the one with most rows takes part (ties: the longer); null ids are carried; repeated rows are
answered each, their vector counts once in the fit list; eigenvalues of zero give no component (no rows if all vectors
are equal), so rows have min(4, rank) components; equal eigenvalues give any orthonormal vectors of their space; an
empty table gives no rows; deviation is null where a long can't hold it (deviation_exact is a decimal of up to 38
digits); extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm.tables import discard, written

SCALE = 256.0
COMPONENTS = 4
LIMB = 40  # bits; a long holds the sum of 2^23 limbs
DIGITS = 90
WIDTH = 208  # bits
PRIMES_PER_TASK = 16


# -- integer vectors ---------------------------------------------------------------------------------------------------

def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, x) of usable rows; x holds the integers as little-endian 64-bit words."""
    def run(batches):
        for b in batches:
            lists = b.column(1)
            usable = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(usable, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
            with np.errstate(all="ignore"):
                whole = np.floor(flat * SCALE)
                good = np.abs(whole) < 2.0**63
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            usable &= (sizes > 0) & (bad[ends] == bad[ends - sizes])
            ints = np.where(good, whole, 0).astype("<i8")
            x = [ints[e - n:e].tobytes() if u else None for u, e, n in zip(usable.tolist(), ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), pa.array(x, pa.binary())],
                                             names=["id", "d", "x"]).filter(pa.array(usable))

    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, d int, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x as 64-bit integers if ``bound`` on what will be computed fits, else as Python's."""
    return x if bound < 2**62 else x.astype(object)


def scatter_sums(fit: DataFrame, d: int) -> tuple[int, int, list[int], list[list[int]]]:
    """(n, largest absolute entry, sums, products) of the fit list (x), exact.  Its result has (d + 1)^2 numbers."""
    def run(batches):
        n, top = 0, 0
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            for i in range(0, len(b), 4096):
                x = _matrix(b.column(0).slice(i, 4096), d)
                if not len(x):
                    continue
                high = max(int(x.max()), -int(x.min()))
                n, top = n + len(x), max(top, high)
                if high * high * len(x) < 2**53:  # every partial sum is exact in a double
                    y = np.column_stack([x.astype(np.float64), np.ones(len(x))])
                    total += (y.T @ y).astype(np.int64).astype(object)
                else:
                    y = np.column_stack([x.astype(object), np.ones(len(x), object)])
                    total += y.T @ y
        if n:
            rows = [(-1, -1, 0, top)]
            for i in range(d + 1):
                for j in range(i, d + 1):
                    v, k = abs(int(total[i, j])), 0
                    sign = 1 if total[i, j] >= 0 else -1
                    while v:
                        rows.append((i, j, k, sign * (v & ((1 << LIMB) - 1))))
                        v, k = v >> LIMB, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38)))],
                                             names=["i", "j", "k", "part"])

    limbs = fit.select("x").mapInArrow(run, "i int, j int, k int, part decimal(38,0)")
    # at most two or three limbs of (d + 1)^2 / 2 numbers, whatever the rows
    found = limbs.groupBy("i", "j", "k").agg(F.sum("part").alias("s"), F.max("part").alias("m")).collect()
    total = [[0] * (d + 1) for _ in range(d + 1)]
    top = 0
    for i, j, k, s, m in found:
        if i < 0:
            top = int(m)
            continue
        total[i][j] += int(s) << (LIMB * k)
    for i in range(d + 1):
        for j in range(i):
            total[i][j] = total[j][i]
    return total[d][d], top, total[d][:d], [r[:d] for r in total[:d]]


# -- characteristic polynomial -------------------------------------------------------------------------------------------

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest odd primes below ``top``."""
    small = [p for p in range(3, int(top**0.5) + 2, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    out, p = [], top - 1 - top % 2
    while len(out) < count:
        if all(p % q for q in small if q < p):
            out.append(p)
        p -= 2
    return out


def _inverses(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a, p)], np.int64)


def polynomials_modulo(m: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(xI - m) modulo each prime below 2^31, all primes at once."""
    d, p = len(m), np.array(primes, np.int64)
    h = np.array([[[v % q for v in row] for row in m] for q in primes], np.int64).reshape(len(primes), d, d)
    at, p1, p2 = np.arange(len(p)), p[:, None], p[:, None, None]
    for k in range(d - 2):  # zeros below the first subdiagonal of column k, by similarity
        pivot = k + 1 + (h[:, k + 1:, k] != 0).argmax(axis=1)
        h[at, pivot], h[at, k + 1] = h[at, k + 1], h[at, pivot]
        h[at, :, pivot], h[at, :, k + 1] = h[at, :, k + 1], h[at, :, pivot]
        factor = h[:, k + 2:, k] * _inverses(h[:, k + 1, k], p)[:, None] % p1
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, None, k + 1] % p2) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % p2).sum(axis=2)) % p1
    polys = np.zeros((d + 1, len(p), d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):  # of the leading k rows and columns
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = polys[k - 1][:, :-1]
        new = (new - h[:, k - 1, k - 1, None] * polys[k - 1]) % p1
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new = (new - (h[:, i - 1, k - 1] * below % p)[:, None] * polys[i - 1]) % p1
        polys[k] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients (lowest first) of det(xI - m), m symmetric without negative eigenvalues."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = 2 * max(-(-comb(d, k) * trace**k // d**k) for k in range(d + 1)) + 1
    primes = primes_below(2**31, bound.bit_length() // 30 + 1)
    schema = "p long, k int, c long"

    def run(batches):
        for b in batches:
            own = [primes[i] for i in b.column(0).to_pylist()]
            for i in range(0, len(own), PRIMES_PER_TASK):
                part = own[i:i + PRIMES_PER_TASK]
                c = polynomials_modulo(m, part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, d + 1)), pa.array(np.tile(np.arange(d + 1, dtype=np.int32), len(part))),
                                                  pa.array(c.ravel())], names=["p", "k", "c"])

    tasks = -(-len(primes) // PRIMES_PER_TASK)
    # the polynomial itself: d + 1 coefficients for each prime
    found = spark.range(0, len(primes), 1, tasks).mapInArrow(run, schema).collect()
    residues: dict[int, list[int]] = {}
    for p, k, c in found:
        residues.setdefault(p, [0] * (d + 1))[k] = c
    value, product = [0] * (d + 1), 1
    for p, rest in residues.items():
        inverse = pow(product, -1, p)
        value = [v + product * ((c - v) * inverse % p) for v, c in zip(value, rest)]
        product *= p
    return [v if 2 * v < product else v - product for v in value]


# -- roots ------------------------------------------------------------------------------------------------------------

def roots_above(poly: list[int], a: int, shift: int) -> int:
    """Roots above a / 2^shift of a polynomial that has real roots only, with multiplicity."""
    d = len(poly) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(poly)]  # its roots are 2^shift times as large
    for i in range(d):  # c(x + a)
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(a, b, shift) of the ``count`` largest roots, falling: a / 2^shift < root <= b / 2^shift, within a relative
    2^-WIDTH; roots that have not parted by then share their interval.  Roots of zero are left out."""
    d = len(poly) - 1
    positive = d - next(k for k, v in enumerate(poly) if v)
    high = 1 << max(1, (-poly[d - 1]).bit_length())  # above the trace
    found: list[tuple[int, int, int]] = []

    def part(a: int, b: int, shift: int, above_a: int, above_b: int) -> None:
        """Roots in (a, b], ``above_*`` of all roots lie above the ends; the larger half first."""
        if above_a == above_b or len(found) >= count:
            return
        if b - a == 1 and a >> WIDTH:
            found.extend([(a, b, shift)] * min(above_a - above_b, count - len(found)))
            return
        if b - a == 1:
            a, b, shift = a << 8, b << 8, shift + 8
        middle = (a + b) // 2
        above = roots_above(poly, middle, shift)
        part(middle, b, shift, above, above_b)
        part(a, middle, shift, above_a, above)

    part(0, high, 0, positive, 0)
    return found


def components(m: list[list[int]], intervals: list[tuple[int, int, int]]) -> tuple[list[Decimal], list[list[float]]]:
    """(eigenvalues, unit eigenvectors) by inverse iteration in long decimals."""
    d, values, vectors = len(m), [], []
    with localcontext() as context:
        context.prec = DIGITS
        exact = [[Decimal(v) for v in row] for row in m]
        cluster: list[list[Decimal]] = []
        for at, (a, b, shift) in enumerate(intervals):
            root = (Decimal(a) + Decimal(b)) / 2 / Decimal(2) ** shift
            if at and intervals[at - 1] != (a, b, shift):
                cluster = []
            lower, order = _factored([[v - root if i == j else v for j, v in enumerate(row)] for i, row in enumerate(exact)], root)
            v = [Decimal((7919 * (i + 1) * (len(cluster) + 1)) % 1009 + 1) for i in range(d)]
            for _ in range(4):
                v = _unit(_orthogonal(_solved(lower, order, _unit(_orthogonal(v, cluster))), cluster))
            cluster.append(v)
            values.append(root)
            vectors.append([float(x) for x in v])
    return values, vectors


def _orthogonal(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for o in others:
            s = sum(x * y for x, y in zip(v, o))
            v = [x - s * y for x, y in zip(v, o)]
    return v


def _unit(v: list[Decimal]) -> list[Decimal]:
    size = sum(x * x for x in v).sqrt()
    return [x / size for x in v]


def _factored(a: list[list[Decimal]], root: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """LU factors with row exchanges, in place; a pivot of zero becomes a very small number."""
    d, order = len(a), list(range(len(a)))
    tiny = root.scaleb(-DIGITS + 5)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        for i in range(k + 1, d):
            f = a[i][k] / a[k][k]
            a[i][k] = f
            if f:
                a[i][k + 1:] = [x - f * y for x, y in zip(a[i][k + 1:], a[k][k + 1:])]
    return a, order


def _solved(a: list[list[Decimal]], order: list[int], v: list[Decimal]) -> list[Decimal]:
    d = len(a)
    x = [v[i] for i in order]
    for i in range(d):
        x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
    return x


# -- results ----------------------------------------------------------------------------------------------------------

def _projected(vectors: DataFrame, n: int, top: int, sums: list[int], values: list[Decimal], axes: list[list[float]]) -> DataFrame:
    """(id, deviation_exact, whitened array) of every integer vector."""
    d = len(sums)
    bound = 2 * n * top * d
    s = np.array(sums, np.int64 if bound < 2**62 else object)
    directions = np.array(axes).T / np.array([float(v.sqrt()) for v in values])

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.slice(i, 4096)
                x = _exact(_matrix(part.column(1), d), bound)
                away = n * x - s
                square = _exact(away, bound * bound)
                deviation = (square * square).sum(axis=1)
                white = away.astype(np.float64) @ directions
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([str(v) for v in deviation.tolist()]), pa.array(list(white), pa.list_(pa.float64()))],
                    names=["id", "deviation", "w"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "x").mapInArrow(run, f"id {kind}, deviation string, w array<double>")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_exact of every usable row and component."""
    spark = rows.sparkSession
    vectors = written(integer_vectors(rows, id_col, vector_col), "integer_vectors")
    size = vectors.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    kind = rows.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, "
                                      "identity_error double, deviation_exact decimal(38,0)")
    if size is None:
        return empty
    d = size["d"]
    vectors = vectors if vectors.select("d").distinct().count() == 1 else vectors.where(F.col("d") == d)
    fit = written(vectors.select("x").distinct(), "fit_list")
    n, top, sums, products = scatter_sums(fit, d)
    m = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(m[i][i] for i in range(d))
    if not trace:
        discard(fit)
        return empty
    values, axes = components(m, largest_roots(characteristic_polynomial(spark, m), count))
    fitted = _projected(fit.select(F.lit(0).alias("id"), "x"), n, top, sums, values, axes)
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    covariance = fitted.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()  # one row of ten numbers
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))
    discard(fit)
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = _projected(vectors, n, top, sums, values, axes).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                      F.col("deviation").try_cast("long").alias("deviation"), "whitened", explained[F.col("at")].alias("explained"),
                      F.lit(error).alias("identity_error"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation_exact"))
