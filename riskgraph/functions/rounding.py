"""Rounding of quotients of whole numbers as Python's ``round`` does it: half-even on the exact value of the double.

``round(n / d, k)`` looks at the double nearest to n / d, not at its decimal text.  With whole n and d below 2^53 and
d below 1e11 the double can only fall on the other side of a tie if n / d is itself a tie, so everything else is decided by
the remainder in whole numbers, and a tie by the double's own error, which is the exact difference of two products.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2^27 + 1: cuts a double into two halves whose products are exact


def ratio_sql(n: str, d: str, digits: int) -> str:
    """SQL text (Spark and DuckDB) of Python's ``round(n / d, digits)`` for whole numbers n >= 0 and d > 0."""
    scale = 10**digits
    q, rest = f"(({n}) * {scale} - (({n}) * {scale}) % ({d}))", f"((({n}) * {scale}) % ({d}))"
    whole = f"CAST(CAST({q} AS DOUBLE) / CAST({d} AS DOUBLE) AS BIGINT)"
    x, dd = f"(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE))", f"CAST({d} AS DOUBLE)"

    def halves(v: str) -> tuple[str, str]:
        high = f"({v} * CAST({SPLIT:.1f} AS DOUBLE) - ({v} * CAST({SPLIT:.1f} AS DOUBLE) - {v}))"
        return high, f"({v} - {high})"

    (xh, xl), (dh, dl) = halves(x), halves(dd)
    product = f"({x} * {dd})"
    # x * d - n exactly: the product's difference from n, and the product's own error
    error = f"(({product} - CAST({n} AS DOUBLE)) + ((({xh} * {dh} - {product}) + {xh} * {dl} + {xl} * {dh}) + {xl} * {dl}))"
    up = (f"CASE WHEN 2 * {rest} > ({d}) THEN 1 WHEN 2 * {rest} < ({d}) THEN 0 "
          f"WHEN {error} > 0 THEN 1 WHEN {error} < 0 THEN 0 ELSE {whole} % 2 END")
    return f"(CAST({whole} + {up} AS DOUBLE) / CAST({scale} AS DOUBLE))"


def python_round_ratio(n: Column, d: Column, digits: int) -> Column:
    """``round(n / d, digits)`` of Python for whole numbers n >= 0 and d > 0 (NULL if one is NULL)."""
    n, d = n.cast("long"), d.cast("long")
    scale = F.lit(10**digits).cast("long")
    rest = (n * scale) % d
    whole = ((n * scale - rest).cast("double") / d.cast("double")).cast("long")
    x, dd = n.cast("double") / d.cast("double"), d.cast("double")

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * F.lit(SPLIT) - (v * F.lit(SPLIT) - v)
        return high, v - high

    (xh, xl), (dh, dl) = halves(x), halves(dd)
    product = x * dd
    error = (product - n.cast("double")) + (((xh * dh - product) + xh * dl + xl * dh) + xl * dl)
    up = (F.when(2 * rest > d, F.lit(1)).when(2 * rest < d, F.lit(0))
          .when(error > 0, F.lit(1)).when(error < 0, F.lit(0)).otherwise(whole % 2))
    return (whole + up).cast("double") / F.lit(float(10**digits))


def share(part: Column, of: Column) -> Column:
    """A risky share: part / max(of, 1), rounded to 4 digits."""
    return python_round_ratio(part, F.greatest(of, F.lit(1)), 4)


def round_share(column: Column) -> Column:
    """A share of 4 digits, rounded again to 2."""
    return python_round_ratio(F.round(column * 10000).cast("long"), F.lit(10000), 2)


def round_share_sql(column: str) -> str:
    return ratio_sql(f"CAST(round({column} * 10000) AS BIGINT)", "10000", 2)
