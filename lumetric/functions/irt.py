"""Column functions of item response models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959964


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def p_correct(theta: Column, a: Column, b: Column, c: Column | None = None) -> Column:
    p = sigmoid(a * (theta - b))
    return p if c is None else c + (1 - c) * p


def information(theta: Column, a: Column, b: Column, c: Column | None = None) -> Column:
    """Fisher information of one answer at theta."""
    guess = F.lit(0.0) if c is None else c
    p = clip(p_correct(theta, a, b, guess), 1e-12, 1 - 1e-12)
    return a * a * (1 - p) / p * F.pow((p - guess) / (1 - guess), 2)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null where a side is constant, also under ANSI arithmetic."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-9) & (sy > 1e-9), F.try_divide(F.covar_pop(x, y), sx * sy))


def wilson(k: Column, n: Column, z: float = Z95, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson score interval of k of n; null where n is 0."""
    p, zz = F.try_divide(k, n), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = centre - half, centre + half
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.when(n > 0, low), F.when(n > 0, high)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational fit, error under 1.2e-7).

    The coefficients are the fixed values of that well-known fit.
    """
    t = 1 / (1 + 0.5 * x)
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(fit[-1])
    for k in reversed(fit[:-1]):
        poly = F.lit(k) + t * poly
    return t * F.exp(-x * x + poly)


def chi2_1_tail(x: Column) -> Column:
    return erfc(F.sqrt(x / 2))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided test of k of n at one half; null where n is 0."""
    logs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.ln(i.cast("double")))
    small = F.least(k, n - k)

    def log_choose(j: Column) -> Column:
        def up_to(m: Column) -> Column:
            return F.aggregate(F.slice(logs, 1, m.cast("int")), F.lit(0.0), lambda a, x: a + x)

        return up_to(n) - up_to(j) - up_to(n - j)

    tail = F.aggregate(F.transform(F.sequence(F.lit(0), small.cast("int")), lambda j: F.exp(log_choose(j.cast("bigint")) - n * F.ln(F.lit(2.0)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))
