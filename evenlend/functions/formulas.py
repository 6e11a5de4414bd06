"""Closed forms applied to a handful of aggregated numbers (never to data rows)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

Z95 = 1.959963984540054


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x): regularised upper incomplete gamma."""
    if x is None or math.isnan(x):
        return float("nan")
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1.0
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = z + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return front * h


def kolmogorov_tail(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov distance."""
    z = d * math.sqrt(n1 * n2 / (n1 + n2))
    if z < 1e-3:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 2001))
    return min(1.0, max(0.0, 2.0 * total))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def two_sided(z: Column) -> Column:
    """``normal_two_sided`` of a column with a row per coefficient; NULL stays NULL."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else normal_two_sided(v) for v in values.to_pylist()], pa.float64())

    return run(z)


@F.pandas_udf(T.DoubleType())
def chi2_1df_p(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Upper tail of chi-square(1) for a column of aggregated statistics."""
    for stat in batches:
        half = np.sqrt(np.maximum(stat.to_numpy(dtype=float), 0.0) / 2.0)
        yield pd.Series([math.erfc(v) if v == v else None for v in half], dtype="float64")


def pretty_breaks(lo: float, hi: float, n: int) -> list[float]:
    """About ``n`` equal intervals with round-number edges (1-2-5 rule) that cover [lo, hi]."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or n < 1:
        raise ValueError("pretty_breaks needs finite limits and n >= 1")
    high_bias, five_bias = 1.5, 2.75
    span = hi - lo
    cell = span / n if span > 0 else max(abs(lo), 1.0) / n
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    for multiple, bias in ((2.0, high_bias), (5.0, five_bias), (10.0, high_bias)):
        if multiple * base - cell < bias * (cell - unit):
            unit = multiple * base
        else:
            break
    first = math.floor(lo / unit + 1e-10)
    last = math.ceil(hi / unit - 1e-10)
    if last == first:
        last += 1
    return [unit * k for k in range(first, last + 1)]


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function: a start from the tail's asymptote, then Newton steps on its logarithm."""
    low = np.minimum(p, 1.0 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2.0 * np.log(low))
        x = np.where(low > 0.02, (0.5 - low) * math.sqrt(2.0 * math.pi), t - np.log(t * math.sqrt(2.0 * math.pi)) / t)
        for _ in range(30):
            tail = np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in x])
            density = np.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
            step = (np.log(tail) - np.log(low)) * tail / density
            x = x + step
            if not np.nanmax(np.abs(step), initial=0.0) > 1e-14:
                break
    return np.where(p < 0.5, -x, x)


def normal_quantiles(p: Column) -> Column:
    """Quantiles of the standard normal for a column of distinct probabilities."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(_normal_quantile(values.to_numpy(zero_copy_only=False).astype(float)))

    return run(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction; the binomial tail P(X >= k) is ``beta_cdf(p, k, n - k + 1)``."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of ``beta_cdf`` in ``x`` by halving."""
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2.0


def exact_proportion(hits: Column, n: Column, null_share: Column) -> Column:
    """For aggregated counts: ``[lower, upper, p]``, the exact 95% interval of a share and the chance of as many hits under ``null_share``."""

    @F.arrow_udf("array<double>")
    def run(hits: pa.Array, n: pa.Array, null_share: pa.Array) -> pa.Array:
        out = []
        for k, size, share in zip(hits.to_pylist(), n.to_pylist(), null_share.to_pylist()):
            if not size or share is None:
                out.append([None, None, None])
                continue
            lower = beta_quantile(0.025, k, size - k + 1) if k > 0 else 0.0
            upper = beta_quantile(0.975, k + 1, size - k) if k < size else 1.0
            out.append([lower, upper, beta_cdf(share, k, size - k + 1) if k > 0 else 1.0])
        return pa.array(out, pa.list_(pa.float64()))

    return run(hits.cast("double"), n.cast("double"), null_share.cast("double"))


def kolmogorov_exact(steps: list[tuple[int, int]]) -> float:
    """Exact P(D >= d) of two samples given the counts of both at every distinct value, in order.

    All orders of the pooled sample are equally likely; a walk over them is looked at only where the value changes, and the walks
    that stay nearer than the observed distance are followed by their probability.
    """
    n1, n2 = (sum(s[i] for s in steps) for i in (0, 1))
    if n1 > n2:
        return kolmogorov_exact([(b, a) for a, b in steps])
    seen = np.cumsum([a + b for a, b in steps])
    first = np.cumsum([a for a, _ in steps])
    worst = max((abs(int(i) * n2 - int(k - i) * n1) for i, k in zip(first, seen)), default=0)
    places, total = set(seen.tolist()), n1 + n2
    i = np.arange(n1 + 1)
    chance = np.zeros(n1 + 1)
    chance[0] = 1.0
    for k in range(total):
        grown = chance * np.maximum(n2 - (k - i), 0) / (total - k)
        grown[1:] += (chance * (n1 - i) / (total - k))[:-1]
        if k + 1 in places:
            grown[np.abs(i * n2 - (k + 1 - i) * n1) >= worst] = 0.0
        chance = grown
    return min(1.0, max(0.0, 1.0 - float(chance.sum())))
