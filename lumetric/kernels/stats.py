"""Numpy kernels: logistic DIF, eigenvalues against chance, exact tetrachorics."""

from __future__ import annotations

import math

import numpy as np

RIDGE, LEAST = 1e-4, 20


def irls(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> float:
    """The log likelihood at the ridge-stabilised logistic fit."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), x.T @ (y - p) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def logistic_dif(theta: np.ndarray, focal: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """p values of uniform and of non-uniform DIF; NaN where it can't be told."""
    if len(y) < LEAST or y.min() == y.max() or focal.min() == focal.max():
        return math.nan, math.nan
    one = np.ones(len(y))
    fits = [irls(np.column_stack(cols), y) for cols in ([one, theta], [one, theta, focal], [one, theta, focal, theta * focal])]
    return tuple(math.erfc(math.sqrt(max(2 * (b - a), 0) / 2)) for a, b in zip(fits, fits[1:], strict=False))


def eigenvalues(answers: np.ndarray) -> np.ndarray:
    """Of the correlations of complete columns, descending; constant columns drop out."""
    sd = answers.std(axis=0)
    keep = answers[:, sd > 1e-9]
    return np.sort(np.linalg.eigvalsh(np.corrcoef(keep, rowvar=False)))[::-1] if keep.shape[1] > 1 else np.ones(keep.shape[1])


def permuted(answers: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.permutation(col) for col in answers.T])


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9))


_GX, _GW = np.polynomial.legendre.leggauss(48)


def bivariate(h: float, k: float, rho: float) -> float:
    """P(X <= h, Y <= k) of correlated normals, by integrating over the correlation's angle."""
    top = math.asin(rho)
    t = np.sin((_GX + 1) * top / 2)
    f = np.exp(-(h * h + k * k - 2 * h * k * t) / (2 * (1 - t * t)))
    return normal_cdf(h) * normal_cdf(k) + float((_GW * f).sum()) * top / 2 / (2 * math.pi)


def tetrachoric(n11: float, n10: float, n01: float, n00: float) -> float:
    """The correlation whose bivariate normal gives the table (half a count added)."""
    a, b, c, d = (n + 0.5 for n in (n11, n10, n01, n00))
    n = a + b + c + d
    h, k, want = normal_quantile((a + b) / n), normal_quantile((a + c) / n), a / n
    low, high = -0.999, 0.999
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if bivariate(h, k, mid) < want else (low, mid)
    return (low + high) / 2
