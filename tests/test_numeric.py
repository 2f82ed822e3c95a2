"""Identities and planted truths of the numerical kernels."""

import math

import numpy as np
import pytest

from tidemark.functions import numeric as nm
from tidemark.functions import scoring



def test_prices_and_parity():
    assert nm.bsm(42, 40, 0.5, 0.10, 0.20) == pytest.approx(4.76, abs=0.005)
    assert nm.bsm(42, 40, 0.5, 0.10, 0.20, call=False) == pytest.approx(0.81, abs=0.005)
    f, k, t, r = 4000.0, 4150.0, 40 / 365, 0.065
    c, p = nm.black76(f, k, t, r, 0.24), nm.black76(f, k, t, r, 0.24, False)
    assert c - p == pytest.approx(math.exp(-r * t) * (f - k), abs=1e-10 * f)
    assert k + math.exp(r * t) * (c - p) == pytest.approx(f)


def test_implied_volatility_comes_back_and_respects_bounds():
    k, s = np.array([80.0, 100, 120]), np.array([0.15, 0.3, 0.6])
    assert nm.implied_vol(nm.black76(100, k, 0.5, 0.05, s), 100, k, 0.5, 0.05) == pytest.approx(s, abs=1e-7)
    assert np.isnan(nm.implied_vol([0.0, 200.0], 100, 90, 0.5, 0.05)).all()


def test_greeks_equal_differences():
    f, k, t, r, s, e = 100.0, 95.0, 0.7, 0.03, 0.25, 1e-4
    g, price = nm.greeks(f, k, t, r, s), lambda f=f, s=s, t=t: float(nm.black76(f, k, t, r, s))
    assert g["delta"] == pytest.approx((price(f + e) - price(f - e)) / (2 * e), rel=1e-5)
    assert g["gamma"] == pytest.approx((price(f + 1e-2) - 2 * price() + price(f - 1e-2)) / 1e-4, rel=1e-3)
    assert g["vega"] == pytest.approx((price(s=s + e) - price(s=s - e)) / (2 * e), rel=1e-5)
    assert g["theta"] == pytest.approx(-(price(t=t + e) - price(t=t - e)) / (2 * e), rel=1e-4)


def test_garch_recovers_and_does_not_look_ahead():
    rng = np.random.default_rng(3)
    h, r = 1.0, []
    for _ in range(3000):
        r.append(rng.standard_t(8) * math.sqrt(h * 6 / 8))
        h = 0.05 + 0.08 * r[-1] ** 2 + 0.87 * h
    r = np.array(r)
    p = nm.garch_fit(r, steps=400)
    assert 0.85 < p["alpha"] + p["beta"] < 1 and 0.02 < p["alpha"] < 0.2
    full = nm.garch_filter(r, p["mu"], p["omega"], p["alpha"], p["beta"], start=1.0)
    short = nm.garch_filter(r[:500], p["mu"], p["omega"], p["alpha"], p["beta"], start=1.0)
    assert full[:501] == pytest.approx(short)


def test_spillover_of_a_planted_driver():
    rng = np.random.default_rng(0)
    a = np.zeros((1500, 3))
    for t in range(1, 1500):
        e = rng.standard_normal(3)
        a[t] = [0.5 * a[t - 1, 0] + e[0], 0.2 * a[t - 1, 1] + 0.6 * a[t - 1, 0] + e[1], 0.2 * a[t - 1, 2] + 0.6 * a[t - 1, 0] + e[2]]
    theta = nm.gfevd(a)
    net = theta.sum(0) - theta.sum(1)
    assert theta.sum(1) == pytest.approx(np.ones(3)) and net[0] > 0 > net[1] and net[2] < 0


def test_errors_tests_and_intervals():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 2))
    y = 1 + x @ [0.5, 0.0] + rng.standard_normal(400)
    b, se = nm.robust(y, x)
    assert b == pytest.approx([1, 0.5, 0], abs=0.2) and se == pytest.approx(np.full(3, 0.05), abs=0.02)
    assert nm.robust(y, x, 5)[1] == pytest.approx(se, rel=0.5)
    assert nm.diebold_mariano(np.ones(50)) == (0.0, 1.0)
    stat, p = nm.diebold_mariano(rng.standard_normal(300) + 0.5, 5)
    assert stat > 3 and p < 0.01
    low, high = nm.block_interval(rng.standard_normal(500) + 2, 500)
    assert low < 2.1 and high > 1.9
    losses = np.column_stack([rng.standard_normal(500) ** 2, rng.standard_normal(500) ** 2 + 1.0])
    assert nm.confidence_set(losses, draws=300) == [0]
    assert nm.binomial_tail(0, 5) == pytest.approx(2 / 32)


def test_small_graphs():
    path = {("a", "b"): 1.0, ("b", "c"): 1.0}
    assert nm.betweenness(["a", "b", "c"], path) == {"a": 0.0, "b": 1.0, "c": 0.0} or nm.betweenness(["a", "b", "c"], path)["b"] == pytest.approx(2.0 / 2)
    two = {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1, ("x", "y"): 1, ("y", "z"): 1, ("x", "z"): 1, ("c", "x"): 1}
    groups, q = nm.greedy_communities(list("abcxyz"), two)
    assert sorted(map(sorted, groups)) == [list("abc"), list("xyz")] and q == pytest.approx(6 / 7 - 0.5)
    assert nm.greedy_communities(["a"], {})[1] == 0.0
    e = nm.eigenvector(["a", "b", "c", "z"], path)
    assert [e[n] for n in "abcz"] == pytest.approx([0.5, 0.5**0.5, 0.5, 0.0]) and nm.eigenvector(["a"], {}) == {"a": 0.0}


def test_temperature():
    rng = np.random.default_rng(2)
    assert scoring.probabilities(np.array([[4.0, 0, 0]]), 2)[0, 0] < scoring.probabilities(np.array([[4.0, 0, 0]]))[0, 0]
    z = rng.standard_normal((2000, 3)) * 2
    y = np.array([rng.choice(3, p=q) for q in scoring.probabilities(z, 2.0)])
    assert scoring.fit_temperature(z, y) == pytest.approx(2.0, rel=0.25)
