"""Numerical kernels in numpy: least squares, robust errors, GARCH, VAR shares, option prices, bootstraps, the confidence set."""

from __future__ import annotations

import math

import numpy as np

erfc = np.vectorize(math.erfc, otypes=[float])


def phi(x):
    """Standard normal distribution function."""
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def two_sided(z: float) -> float:
    return float(math.erfc(abs(z) / math.sqrt(2)))


def ols(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares with an intercept first."""
    return np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]


def standardised(x: np.ndarray, ddof: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of columns; a deviation of zero counts as one."""
    sd = x.std(0, ddof=ddof)
    return x.mean(0), np.where(sd > 0, sd, 1.0)


def robust(y: np.ndarray, x: np.ndarray, lags: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors: HC3 without `lags`, else Newey-West with Bartlett weights."""
    a = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.pinv(a.T @ a)
    b = inv @ a.T @ y
    e = y - a @ b
    if lags is None:
        h = np.einsum("ij,jk,ik->i", a, inv, a)
        meat = (a * ((e / (1 - h)) ** 2)[:, None]).T @ a
    else:
        s = a * e[:, None]
        meat = s.T @ s
        for k in range(1, lags + 1):
            g = s[k:].T @ s[:-k]
            meat += (1 - k / (lags + 1)) * (g + g.T)
    return b, np.sqrt(np.diag(inv @ meat @ inv))


def garch_filter(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float, gamma: float = 0.0, start: float | None = None) -> np.ndarray:
    """One-step variances h[t] given r[:t]; one more than r, the last for the next day."""
    e = r - mu
    h = np.empty(len(r) + 1)
    h[0] = float(np.mean(e**2)) if start is None else start
    h[1:] = omega + (alpha + gamma * (e < 0)) * e**2
    # h[t] = sum of beta**k x[t - k]: each pass adds twice as many lags as the one before, until their weight is nothing.
    step, fade = 1, beta
    while step < len(h) and abs(fade) > 1e-18:
        h[step:] += fade * h[:-step]
        step, fade = 2 * step, fade * fade
    return h


def _student(r: np.ndarray, p: np.ndarray, asymmetric: bool) -> float:
    """Negative log likelihood with Student-t errors; p is unconstrained."""
    mu, nu = p[0], 2.05 + math.exp(min(p[4], 6))
    share = 1 / (1 + math.exp(-p[2]))
    alpha = share / (1 + math.exp(-p[3]))
    gamma = 2 * (share - alpha) / (1 + math.exp(-p[5])) if asymmetric else 0.0
    beta = share - alpha - gamma / 2
    h = garch_filter(r, mu, math.exp(p[1]), alpha, beta, gamma)[:-1]
    z = (r - mu) ** 2 / (h * (nu - 2))
    one = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(-(one - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(z)).sum())


def garch_fit(r: np.ndarray, asymmetric: bool = False, steps: int = 200) -> dict:
    """GARCH(1,1) or GJR parameters by maximum likelihood (Nelder-Mead on unconstrained coordinates)."""
    p0 = np.array([r.mean(), math.log(max(r.var(), 1e-12) * 0.05), 3.0, -2.5, 1.5, -2.0][: 6 if asymmetric else 5])
    best = nelder_mead(lambda p: _student(r, np.append(p, 0.0) if not asymmetric else p, asymmetric), p0, steps)
    share = 1 / (1 + math.exp(-best[2]))
    alpha = share / (1 + math.exp(-best[3]))
    gamma = 2 * (share - alpha) / (1 + math.exp(-best[5])) if asymmetric else 0.0
    return {"mu": float(best[0]), "omega": math.exp(best[1]), "alpha": alpha, "gamma": gamma, "beta": share - alpha - gamma / 2, "nu": 2.05 + math.exp(min(best[4], 6))}


def nelder_mead(f, x0: np.ndarray, steps: int) -> np.ndarray:
    n = len(x0)
    points = np.vstack([x0, x0 + np.diag(np.where(np.abs(x0) > 1e-8, 0.1 * np.abs(x0), 0.05))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])):
            break
        centre = points[:-1].mean(0)
        trial = centre + (centre - points[-1])
        v = f(trial)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            trial, v = (far, w) if w < v else (trial, v)
        elif v >= values[-2]:
            near = centre + 0.5 * ((trial if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w >= min(v, values[-1]):
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
            trial, v = near, w
        points[-1], values[-1] = trial, v
    return points[values.argmin()] if n else x0


def gfevd(y: np.ndarray, horizon: int = 10, most: int = 5) -> np.ndarray:
    """Generalised forecast error variance shares (rows sum to one) of a VAR with its lag chosen by BIC."""
    best = None
    for p in range(1, most + 1):
        t = len(y) - most
        x = np.column_stack([np.ones(t), *(y[most - k : len(y) - k] for k in range(1, p + 1))])
        target = y[most:]
        b = np.linalg.lstsq(x, target, rcond=None)[0]
        e = target - x @ b
        s = e.T @ e / t
        bic = np.linalg.slogdet(s)[1] + math.log(t) / t * b.size
        if best is None or bic < best[0]:
            best = (bic, p)
    p, n = best[1], y.shape[1]
    x = np.column_stack([np.ones(len(y) - p), *(y[p - k : len(y) - k] for k in range(1, p + 1))])
    b = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    e = y[p:] - x @ b
    sigma = e.T @ e / (len(e) - b.shape[0])
    lag = [b[1 + n * k : 1 + n * (k + 1)].T for k in range(p)]
    ma = [np.eye(n)]
    for h in range(1, horizon):
        ma.append(sum(ma[h - 1 - k] @ lag[k] for k in range(min(h, p))))
    top = sum((m @ sigma) ** 2 for m in ma) / np.diag(sigma)[None, :]
    bottom = sum(np.diag(m @ sigma @ m.T) for m in ma)
    theta = top / bottom[:, None]
    return theta / theta.sum(1, keepdims=True)


def black76(f, k, t, r, sigma, call=True):
    f, k, t, sigma = (np.asarray(a, float) for a in (f, k, t, sigma))
    with np.errstate(divide="ignore", invalid="ignore"):
        d1 = (np.log(f / k) + 0.5 * sigma**2 * t) / (sigma * np.sqrt(t))
    d2 = d1 - sigma * np.sqrt(t)
    sign = np.where(call, 1.0, -1.0)
    return np.exp(-r * t) * sign * (f * phi(sign * d1) - k * phi(sign * d2))


def bsm(s, k, t, r, sigma, q=0.0, call=True):
    return black76(np.asarray(s, float) * np.exp((r - q) * np.asarray(t, float)), k, t, r, sigma, call)


def greeks(f, k, t, r, sigma, call=True) -> dict:
    """Delta and gamma in the forward, vega per unit of volatility, theta per year."""
    d1 = (np.log(f / k) + 0.5 * sigma**2 * t) / (sigma * np.sqrt(t))
    disc, density = np.exp(-r * t), np.exp(-0.5 * d1**2) / math.sqrt(2 * math.pi)
    delta = disc * (phi(d1) - np.where(call, 0.0, 1.0))
    return {"delta": delta, "gamma": disc * density / (f * sigma * np.sqrt(t)), "vega": disc * f * density * np.sqrt(t), "theta": -disc * f * density * sigma / (2 * np.sqrt(t)) + r * black76(f, k, t, r, sigma, call)}


def implied_vol(price, f, k, t, r, call=True, low: float = 1e-4, high: float = 5.0, rounds: int = 60) -> np.ndarray:
    """Bisection on all rows at once; NaN outside the no-arbitrage bounds or the interval."""
    price, f, k, t = np.broadcast_arrays(*(np.asarray(a, float) for a in (price, f, k, t)))
    call = np.broadcast_to(call, price.shape)
    disc = np.exp(-r * t)
    least = disc * np.maximum(np.where(call, f - k, k - f), 0)
    most = disc * np.where(call, f, k)
    a, b = np.full(price.shape, low), np.full(price.shape, high)
    ok = (t > 0) & (price > least) & (price < most) & (black76(f, k, t, r, a, call) <= price) & (black76(f, k, t, r, b, call) >= price)
    for _ in range(rounds):
        m = 0.5 * (a + b)
        under = black76(f, k, t, r, m, call) < price
        a, b = np.where(under, m, a), np.where(under, b, m)
    return np.where(ok, 0.5 * (a + b), np.nan)


def block_draws(n: int, draws: int, block: int, seed: int) -> np.ndarray:
    """Row numbers of moving-block bootstrap samples."""
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, max(1, n - block + 1), (draws, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]) % n


def block_interval(x: np.ndarray, draws: int = 2000, block: int = 10, seed: int = 0) -> tuple[float, float]:
    m = x[block_draws(len(x), draws, block, seed)].mean(1)
    return float(np.percentile(m, 2.5)), float(np.percentile(m, 97.5))


def diebold_mariano(d: np.ndarray, lags: int | None = None) -> tuple[float, float]:
    """Statistic and normal p-value of a mean loss difference; the lag follows the sample size unless given. A variance of zero or less gives 0."""
    n = len(d)
    k = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    e = d - d.mean()
    v = float(e @ e) / n + sum(2 * (1 - j / (k + 1)) * float(e[j:] @ e[:-j]) / n for j in range(1, k + 1))
    stat = float(d.mean() / math.sqrt(v / n)) if v > 0 else 0.0
    return stat, two_sided(stat)


def confidence_set(losses: np.ndarray, level: float = 0.1, draws: int = 1000, block: int = 10, seed: int = 0) -> list[int]:
    """Models that survive range-statistic elimination at `level`."""
    alive, at = list(range(losses.shape[1])), block_draws(len(losses), draws, block, seed)
    boot = np.stack([losses[:, j][at].mean(1) for j in range(losses.shape[1])], 1)
    mean = losses.mean(0)
    while len(alive) > 1:
        d = mean[alive][:, None] - mean[alive][None, :]
        b = boot[:, alive][:, :, None] - boot[:, alive][:, None, :]
        sd = np.sqrt(((b - d) ** 2).mean(0)) + 1e-300
        t = np.abs(d) / sd
        null = (np.abs(b - d) / sd).max((1, 2))
        if (null >= t.max()).mean() > level:
            break
        alive.pop(int((d / sd).max(1).argmax()))
    return alive


def binomial_tail(k: int, n: int) -> float:
    """Two-sided exact sign test of k of n."""
    low = min(k, n - k)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0


def betweenness(nodes: list, edges: dict) -> dict:
    """Shortest-path betweenness on distances, normalised, of a small undirected graph (edges: pair -> distance)."""
    import heapq

    near: dict = {v: {} for v in nodes}
    for (a, b), w in edges.items():
        near[a][b] = near[b][a] = w
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, ways, back, order, heap = {}, {s: 1.0}, {v: [] for v in nodes}, [], [(0.0, s, s)]
        best = {s: 0.0}
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in near[v].items():
                step = d + w
                if u not in best or step < best[u] - 1e-12:
                    best[u], ways[u], back[u] = step, ways[v], [v]
                    heapq.heappush(heap, (step, u, u))
                elif abs(step - best[u]) <= 1e-12 and u not in dist:
                    ways[u] += ways[v]
                    back[u].append(v)
        dep = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            for u in back[v]:
                dep[u] += ways[u] / ways[v] * (1 + dep[v])
            if v != s:
                score[v] += dep[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def eigenvector(nodes: list, edges: dict) -> dict:
    """Weighted eigenvector centrality on the largest component of a small graph, 0 elsewhere."""
    at = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for (u, v), w in edges.items():
        a[at[u], at[v]] = a[at[v], at[u]] = w
    reach = np.linalg.matrix_power((a > 0) + np.eye(len(nodes)), max(len(nodes), 1)) > 0 if nodes else a
    inside = reach[int(reach.sum(1).argmax())] if nodes and edges else np.zeros(len(nodes), bool)
    x = np.zeros(len(nodes))
    if inside.any():
        values, vectors = np.linalg.eigh(a[np.ix_(inside, inside)])
        x[inside] = np.abs(vectors[:, values.argmax()])
    return dict(zip(nodes, x.tolist(), strict=True))


def greedy_communities(nodes: list, edges: dict) -> tuple[list[set], float]:
    """Communities by greedy modularity merges of a small weighted graph, and the modularity."""
    total = sum(edges.values())
    if not total:
        return [{v} for v in nodes], 0.0
    groups = {v: {v} for v in nodes}
    degree = dict.fromkeys(nodes, 0.0)
    between: dict = {}
    for (a, b), w in edges.items():
        degree[a] += w / (2 * total)
        degree[b] += w / (2 * total)
        key = (min(a, b), max(a, b))
        between[key] = between.get(key, 0.0) + w / (2 * total)
    q = -sum(d * d for d in degree.values())
    while between:
        (a, b), gain = max(((k, 2 * (w - degree[k[0]] * degree[k[1]])) for k, w in between.items()), key=lambda x: (x[1], x[0]))
        if gain <= 0:
            break
        q += gain
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        merged: dict = {}
        for (x, y), w in between.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = (min(x, y), max(x, y))
                merged[key] = merged.get(key, 0.0) + w
        between = merged
    return list(groups.values()), q
