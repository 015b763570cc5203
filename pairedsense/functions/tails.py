"""Tail probabilities of test statistics, for the few rows a test returns.

Spark SQL has no incomplete beta or error function, so these small helpers
run in Arrow batches over result rows only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Value below which a t variable falls with probability p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, df) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of the smaller rank sum, by counting subsets of 1..n."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2.0 * sum(ways[: int(w) + 1]) / 2.0**n)


def _ok(*values) -> bool:
    return all(v is not None and not pd.isna(v) for v in values)


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(float(a), float(b)) if _ok(a, b) and b > 0 else None for a, b in zip(t, df)], dtype="float64")

    return run(t, df.cast("double"))


def t_critical(p: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        known: dict[float, float] = {}
        out = []
        for d in df:
            if not _ok(d) or d <= 0:
                out.append(None)
                continue
            d = float(d)
            if d not in known:
                known[d] = t_quantile(p, d)
            out.append(known[d])
        return pd.Series(out, dtype="float64")

    return run(df.cast("double"))


def z_p_value(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return pd.Series([normal_two_sided(float(x)) if _ok(x) else None for x in z], dtype="float64")

    return run(z.cast("double"))


def signed_rank_p_value(w: Column, n: Column, z: Column, ties: Column, method: str = "exact") -> Column:
    """``exact``: from the distribution of rank sums, where ties allow it; ``normal``: from the score, for any data."""
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method}")

    @F.pandas_udf("double")
    def run(w: pd.Series, n: pd.Series, z: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, m, b, t in zip(w, n, z, ties):
            if not _ok(a, m) or m == 0:
                out.append(None)
            elif method == "exact" and t == 0:
                out.append(signed_rank_exact(float(a), int(m)))
            else:
                out.append(normal_two_sided(float(b)) if _ok(b) else None)
        return pd.Series(out, dtype="float64")

    return run(w.cast("double"), n.cast("double"), z.cast("double"), ties.cast("double"))
