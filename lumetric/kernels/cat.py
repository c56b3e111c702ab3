"""Numpy kernels of adaptive testing."""

from __future__ import annotations

import numpy as np

from .em import EPS, quadrature


class Ability:
    """A running posterior over the quadrature; the order of answers is irrelevant."""

    def __init__(self) -> None:
        self.x, self.log = quadrature()

    def update(self, a: float, b: float, c: float, correct: int) -> None:
        p = np.clip(c + (1 - c) / (1 + np.exp(-a * (self.x - b))), EPS, 1 - EPS)
        self.log = self.log + np.log(p if correct else 1 - p)

    def moments(self) -> tuple[float, float]:
        e = np.exp(self.log - self.log.max())
        post = e / e.sum()
        theta = float(post @ self.x)
        return theta, float(np.sqrt(max(post @ (self.x * self.x) - theta * theta, 0)))


def informations(theta: float, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = np.clip(c + (1 - c) / (1 + np.exp(-a * (theta - b))), 1e-12, 1 - 1e-12)
    return a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2


def adaptive_order(answers: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, strata: np.ndarray, weights: np.ndarray, most: int, top: int = 1, seed: int = 0) -> list[tuple[int, float, float]]:
    """(item, theta, se) after each step over the answered items (NaN: not answered):
    the benchmark with the largest deficit, its most informative item (one of the
    best `top`, drawn by the seed)."""
    rng, ability, free, used = np.random.default_rng(seed), Ability(), ~np.isnan(answers), np.zeros(len(weights))
    out: list[tuple[int, float, float]] = []
    theta = 0.0
    while len(out) < most and free.any():
        open_strata = np.bincount(strata[free], minlength=len(weights)) > 0
        deficit = np.where(open_strata, weights * max(used.sum(), 1) - used, -np.inf)
        pool = np.flatnonzero(free & (strata == int(deficit.argmax())))
        best = pool[np.argsort(-informations(theta, a[pool], b[pool], c[pool]), kind="stable")[:top]]
        item = int(best[rng.integers(len(best))]) if top > 1 else int(best[0])
        ability.update(a[item], b[item], c[item], int(answers[item]))
        free[item] = False
        used[strata[item]] += 1
        theta, se = ability.moments()
        out.append((item, theta, se))
    return out


def scored(answers: np.ndarray, picked: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Ability and its error from some of the items; the prior's, if from none."""
    x, lw = quadrature()
    p = np.clip(c[picked, None] + (1 - c[picked, None]) / (1 + np.exp(-a[picked, None] * (x - b[picked, None]))), EPS, 1 - EPS)
    log = lw + np.where(answers[picked, None] == 1, np.log(p), np.log(1 - p)).sum(axis=0)
    post = np.exp(log - log.max())
    post /= post.sum()
    theta = float(post @ x)
    return theta, float(np.sqrt(max(post @ (x * x) - theta * theta, 0)))


def stratified(there: np.ndarray, n: int, strata: np.ndarray, weights: np.ndarray, b: np.ndarray, rng: np.random.Generator, bins: int = 4) -> np.ndarray:
    """A draw in proportion to benchmarks, spread over runs of difficulty within each; its
    size isn't exactly n."""
    picked = []
    for k, weight in enumerate(weights):
        pool, want = there[strata[there] == k], round(n * float(weight))
        runs = [pool] if len(pool) <= want else np.array_split(pool[np.argsort(b[pool], kind="stable")], bins)
        quota = want if len(runs) == 1 else max(want // bins, 1)
        picked += [rng.permutation(run)[:quota] for run in runs if want > 0]
    return np.sort(np.concatenate(picked)) if picked else np.empty(0, int)


def mle(correct: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, bound: float = 5.0) -> float:
    """Bounded maximum likelihood: a grid for the right hill, then golden sections."""
    if not len(correct) or correct.min() == correct.max():
        return 0.0 if not len(correct) else bound if correct[0] else -bound

    def loss(t: float) -> float:
        p = np.clip(c + (1 - c) / (1 + np.exp(-a * (t - b))), EPS, 1 - EPS)
        return -float(np.log(np.where(correct == 1, p, 1 - p)).sum())

    grid = np.linspace(-bound, bound, 41)
    k = int(np.argmin([loss(t) for t in grid]))
    low, high, g = grid[max(k - 1, 0)], grid[min(k + 1, 40)], (5**0.5 - 1) / 2
    for _ in range(60):
        l, h = high - g * (high - low), low + g * (high - low)
        low, high = (low, h) if loss(l) < loss(h) else (l, high)
    return float((low + high) / 2)


def kendall(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Tau-b; with weights, as if rows were repeated so often."""
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    w = np.ones(len(x)) if weight is None else weight
    ww = np.outer(w, w)
    bottom = np.sqrt((ww * sx * sx).sum() * (ww * sy * sy).sum())
    return float((ww * sx * sy).sum() / bottom) if bottom > 0 else float("nan")
