"""Numpy kernels of marginal maximum likelihood; no Spark here."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NODES, SPAN, EPS = 61, 4.5, 1e-10
A_MAX, D_MAX, C_MAX = 6.0, 30.0, 0.45
HALVINGS, INNER = 10, 2


def quadrature(points: int = NODES, span: float = SPAN) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(-span, span, points)
    w = np.exp(-x * x / 2)
    return x, np.log(w / w.sum())


def probability(x: np.ndarray, a: np.ndarray, d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Items by nodes, in intercept form."""
    s = 1 / (1 + np.exp(-np.clip(np.outer(a, x) + d[:, None], -60, 60)))
    return np.clip(c[:, None] + (1 - c[:, None]) * s, EPS, 1 - EPS)


def posterior(right: np.ndarray, wrong: np.ndarray, lw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From summed log probabilities (rows by nodes): posteriors and log likelihoods."""
    l = right + wrong + lw
    top = l.max(axis=1, keepdims=True)
    e = np.exp(l - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def objective(n: np.ndarray, r: np.ndarray, x: np.ndarray, a: np.ndarray, d: np.ndarray, c: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Expected log likelihood and log prior of each item."""
    p = probability(x, a, d, c)
    prior = -((a - 1) ** 2) / 2 - d * d / 32
    beta = np.where(guess, np.log(np.maximum(c, 1e-6)) + 7 * np.log(1 - c), 0.0)
    return (r * np.log(p) + (n - r) * np.log(1 - p)).sum(axis=1) + prior + beta


def m_step(n: np.ndarray, r: np.ndarray, x: np.ndarray, a: np.ndarray, d: np.ndarray, c: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fisher scoring on (a, d), then on c where an item can be guessed. A step that
    lowers an item's objective is halved for that item until it doesn't."""

    def accept(new: tuple[np.ndarray, ...], old: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        base, scale = objective(n, r, x, *old, guess), np.ones(len(a))
        for _ in range(HALVINGS):
            tried = tuple(o + scale * (w - o) for w, o in zip(new, old, strict=True))
            worse = ~(objective(n, r, x, *tried, guess) >= base - 1e-9)
            if not worse.any():
                return tried
            scale[worse] /= 2
        scale[worse] = 0
        return tuple(o + scale * (w - o) for w, o in zip(new, old, strict=True))

    for _ in range(INNER):
        s = 1 / (1 + np.exp(-np.clip(np.outer(a, x) + d[:, None], -60, 60)))
        p = np.clip(c[:, None] + (1 - c[:, None]) * s, EPS, 1 - EPS)
        slope, v = (1 - c[:, None]) * s * (1 - s), p * (1 - p)
        score, w = (r - n * p) / v * slope, n * slope * slope / v
        ga, gd = (score * x).sum(axis=1) - (a - 1), score.sum(axis=1) - d / 16
        haa, had, hdd = (w * x * x).sum(axis=1) + 1, (w * x).sum(axis=1), w.sum(axis=1) + 1 / 16
        det = np.maximum(haa * hdd - had * had, 1e-10)
        da, dd = np.clip((hdd * ga - had * gd) / det, -2, 2), np.clip((haa * gd - had * ga) / det, -4, 4)
        a, d, c = accept((np.clip(a + da, -A_MAX, A_MAX), np.clip(d + dd, -D_MAX, D_MAX), c), (a, d, c))
        if guess.any():
            p = probability(x, a, d, c)
            s = 1 / (1 + np.exp(-np.clip(np.outer(a, x) + d[:, None], -60, 60)))
            gain, v = 1 - s, p * (1 - p)
            low = np.maximum(c, 1e-3)
            gc = ((r - n * p) / v * gain).sum(axis=1) + 1 / low - 7 / (1 - c)
            hcc = (n * gain * gain / v).sum(axis=1) + 1 / low**2 + 7 / (1 - c) ** 2
            step = np.where(guess, np.clip(gc / hcc, -0.1, 0.1), 0)
            a, d, c = accept((a, d, np.clip(c + step, 0, C_MAX)), (a, d, c))
    return a, d, c


def start(rate: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.clip(rate, 0.02, 0.98)
    return np.ones(len(p)), np.clip(np.log(p / (1 - p)), -6, 6), np.where(guess, 0.15, 0.0)


def difficulty(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    return -d / np.where(np.abs(a) < 1e-3, np.where(a < 0, -1e-3, 1e-3), a)


@dataclass
class Fit:
    a: np.ndarray
    d: np.ndarray
    c: np.ndarray
    post: np.ndarray
    loglik: float
    iterations: int
    converged: bool


def fit_matrix(y: np.ndarray, seen: np.ndarray, guess: np.ndarray | None = None, most: int = 200, begin: tuple | None = None, tolerance: float = 1e-4) -> Fit:
    """EM on a dense matrix (models by items) that fits in one task: for refits."""
    x, lw = quadrature()
    guess = np.zeros(y.shape[1], bool) if guess is None else guess
    right, wrong = np.where(seen, y, 0).astype(float), np.where(seen, 1 - y, 0).astype(float)
    a, d, c = begin or start((right.sum(axis=0) + 1e-9) / np.maximum(seen.sum(axis=0), 1), guess)
    old, converged, post = -np.inf, False, np.empty(0)
    for k in range(1, most + 1):
        p = probability(x, a, d, c)
        post, loglik = posterior(right @ np.log(p), wrong @ np.log(1 - p), lw)
        n, r = seen.T.astype(float) @ post, right.T @ post
        a2, d2, c2 = m_step(n, r, x, a, d, c, guess)
        moved = max(np.abs(a2 - a).max(), np.abs(d2 - d).max(), np.abs(c2 - c).max())
        a, d, c = a2, d2, c2
        total = float(loglik.sum())
        if moved < tolerance or 0 <= total - old < 1e-8 * abs(total):
            converged = True
            break
        old = total
    return Fit(a, d, c, post, total, k, converged)
