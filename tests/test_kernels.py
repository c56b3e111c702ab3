"""Planted truth is recovered; the kernels agree with their definitions."""

import math

import numpy as np
import pytest

from lumetric.kernels import cat, em, math_text, stats


def planted(models=300, items=120, guess=0.0, holes=0.0, seed=1):
    rng = np.random.default_rng(seed)
    theta, a, b = rng.normal(size=models), np.exp(rng.normal(0, 0.35, items)), rng.normal(0, 1.2, items)
    p = guess + (1 - guess) / (1 + np.exp(-a * (theta[:, None] - b)))
    y = (rng.random((models, items)) < p).astype(float)
    y[rng.random(y.shape) < holes] = np.nan
    return theta, a, b, y


@pytest.mark.parametrize("holes", [0.0, 0.5])
def test_two_parameter_recovery(holes):
    _, a, b, y = planted(models=1000, holes=holes)
    fit = em.fit_matrix(np.nan_to_num(y), ~np.isnan(y))
    assert fit.converged
    assert np.corrcoef(em.difficulty(fit.a, fit.d), b)[0, 1] > 0.95
    assert np.corrcoef(fit.a, a)[0, 1] > (0.85 if not holes else 0.7)


def test_negative_slope_is_found():
    _, _, _, y = planted()
    y[:, :5] = 1 - y[:, :5]
    fit = em.fit_matrix(y, np.ones(y.shape, bool))
    assert (fit.a[:5] < 0).all() and (fit.a[5:] > 0).all()


def test_guessing_stays_in_bounds():
    *_, y = planted(guess=0.2)
    fit = em.fit_matrix(y, np.ones(y.shape, bool), np.ones(y.shape[1], bool), most=40)
    assert (fit.c >= 0).all() and (fit.c <= em.C_MAX).all() and fit.c.mean() > 0.05


def test_all_right_and_all_wrong_items_stay_finite():
    *_, y = planted(items=20)
    y[:, 0], y[:, 1] = 1, 0
    fit = em.fit_matrix(y, np.ones(y.shape, bool))
    assert np.isfinite(fit.a).all() and np.isfinite(fit.d).all()


def test_adaptive_beats_random_and_balances():
    rng = np.random.default_rng(4)
    a, b = np.exp(rng.normal(0, 0.3, 600)), rng.normal(0, 1.3, 600)
    strata, c, errors = np.arange(600) % 4, np.zeros(600), {"adaptive": [], "random": []}
    for k in range(25):
        theta = rng.normal()
        y = (rng.random(600) < 1 / (1 + np.exp(-a * (theta - b)))).astype(float)
        path = cat.adaptive_order(y, a, b, c, strata, np.full(4, 0.25), 30, 5, seed=k)
        assert np.ptp(np.bincount(strata[[i for i, *_ in path]], minlength=4)) <= 1
        plain = cat.Ability()
        for i in rng.permutation(600)[:30]:
            plain.update(a[i], b[i], 0, int(y[i]))
        errors["adaptive"].append((path[-1][1] - theta) ** 2)
        errors["random"].append((plain.moments()[0] - theta) ** 2)
        assert path[-1][2] < path[4][2]
    assert np.mean(errors["adaptive"]) < np.mean(errors["random"])


def test_mle_is_near_the_posterior_mean_and_bounded():
    rng = np.random.default_rng(5)
    a, b, c = np.ones(400), rng.normal(size=400), np.zeros(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.7 - b)))).astype(float)
    assert abs(cat.mle(y, a, b, c) - 0.7) < 0.4
    assert cat.mle(np.ones(4), a[:4], b[:4], c[:4]) == 5


def test_kendall_with_ties_and_weights():
    x, y = np.array([1, 2, 2, 4.0]), np.array([1, 3, 2, 2.0])
    rep = np.array([2, 1, 1, 1])
    assert math.isclose(cat.kendall(x, y, rep), cat.kendall(np.repeat(x, rep), np.repeat(y, rep)))


def test_logistic_dif_finds_a_shift():
    rng = np.random.default_rng(6)
    theta, focal = rng.normal(size=600), np.arange(600) % 2 * 1.0
    shifted = (rng.random(600) < 1 / (1 + np.exp(-(theta + 1.5 * focal)))) * 1.0
    plain = (rng.random(600) < 1 / (1 + np.exp(-theta))) * 1.0
    assert stats.logistic_dif(theta, focal, shifted)[0] < 1e-4 < stats.logistic_dif(theta, focal, plain)[0]
    assert math.isnan(stats.logistic_dif(theta[:5], focal[:5], plain[:5])[0])


def test_exact_tetrachoric():
    rng = np.random.default_rng(7)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 20000)
    x, y = z[:, 0] > 0.2, z[:, 1] > -0.3
    n = [(x & y).sum(), (x & ~y).sum(), (~x & y).sum(), (~x & ~y).sum()]
    assert abs(stats.tetrachoric(*n) - 0.6) < 0.04
    assert math.isclose(stats.bivariate(0.0, 0.0, 0.5), 1 / 3, abs_tol=1e-9)


@pytest.mark.parametrize(("reply", "want"), [(r"so \boxed{\frac{1}{2}}", "1/2"), ("Answer: 1,234", "1234"), ("x = 0.50", "1/2"), ("none", None), (r"\boxed{a\text{ b}}", "ab"), (None, None), (r"\boxed{\frac{x}{2}}", r"\frac{x}{2}"), (r"\boxed{1} then \boxed {2", "2"), (r"\boxed{y = \left(3, 4\right)}", "(3,4)"), ("the answer is 3/4.", "3/4"), (r"\boxed{50\%}", "50"), ("7 or -8", "-8"), (r"\boxed{\dfrac{6}{4}}", "3/2"), (r"\boxed{{a}}", "{a}"), (r"\boxed{1/0}", "1/0")])
def test_math(reply, want):
    assert math_text.stated(reply) == want


def test_math_equality():
    assert math_text.same("0.5", r"\frac{1}{2}") and not math_text.same("1/3", "0.3") and math_text.same(r"$1{,}000$", "1{,}000")
