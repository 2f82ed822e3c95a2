"""Expanding regressions, robust errors, placebos, normal columns, ladders, temperatures and streaming variances against plain loops."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions import numeric as nm
from tidemark.operators import evaluate, expanding, graph, options, placebo, robust, walk
from tidemark.streaming import garch, live


def panel(n=260, keys=("A", "B", None), seed=1):
    rng, rows = np.random.default_rng(seed), []
    for key in keys:
        x = rng.normal(size=(n, 3)) * [1, 10, 0.01] + [0, 1000, 5]
        u = x @ [0.3, 0.02, 4] + rng.normal(size=n)
        for t in range(n):
            rows.append((key, date(2018, 1, 1) + timedelta(days=5 * t), None if t % 17 == 3 else float(u[t]), *map(float, x[t]), 7.0, float(t % 2), None if t % 29 == 5 else 2.0 + t % 3))
    return rows


COLUMNS = "symbol string, d date, u double, a double, b double, c double, flat double, twin double, base double"


def walked(rows, features, base, first, size):
    """Each block from scratch on copies of all rows before it."""
    out = {}
    f = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    for key, g in f.groupby("symbol", dropna=False):
        g = g.dropna(subset=[*features, base]).sort_values("d").reset_index(drop=True)
        for start in range(first, len(g), size):
            past, now = g[:start].dropna(subset=["u"]), g[start : start + size]
            x = past[features].to_numpy(float)
            mean, sd = nm.standardised(x)
            sd = np.where(x.std(0) <= 1e-9 * np.abs(x).max(0, initial=0), 1.0, sd)
            z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
            b = np.linalg.lstsq(z, past.u, rcond=None)[0]
            e = past.u - z @ b
            s2 = float(e @ e) / max(len(e) - len(features) - 1, 1)
            u = np.column_stack([np.ones(len(now)), (now[features].to_numpy(float) - mean) / sd]) @ b
            for d, v, h in zip(now.d, u, now[base] * np.exp(u + s2 / 2), strict=True):
                out[None if isinstance(key, float) else key, d] = (v, h)
    return out


@pytest.mark.parametrize("features", [["a", "b", "c"], ["a"], ["a", "flat", "b"], []])
def test_blocks_from_prefix_moments(spark, features):
    rows = panel()
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {(r["symbol"], r["d"]): (r["u_hat"], r["forecast"]) for r in walk.ols(frame, "symbol", "u", features, "base", first=100, size=21).collect()}
    want = walked(rows, features, "base", 100, 21)
    assert set(got) == set(want) and len(want) > 400
    assert max(abs(got[k][i] / want[k][i] - 1) for k in want for i in (0, 1)) < 1e-7


def test_no_row_is_copied_for_blocks(spark):
    frame = spark.createDataFrame(panel(keys=("A",)), COLUMNS)
    plan = expanding.ols(frame, "symbol", "u", ["a", "b"], "base", 60, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan


def yearly(rows, features, kind, least=50):
    f = pd.DataFrame(rows, columns=["id", "d", "y", "a", "b", "c"])
    f["year"] = [x.year for x in f.d]
    f = f.dropna(subset=features)
    out = {}
    for y in sorted(set(f.year)):
        past, now = f[(f.year < y) & f.y.notna()], f[f.year == y]
        if len(past) < least:
            continue
        t = past.y.to_numpy(float)
        if not features:
            out |= dict.fromkeys(now.id, (0.0, 0.0) if kind == "ols" else (t.mean(), None))
            continue
        mean, sd = nm.standardised(past[features].to_numpy(float))
        x, z = ((g[features].to_numpy(float) - mean) / sd for g in (past, now))
        a, n = np.column_stack([np.ones(len(x)), x]), np.column_stack([np.ones(len(z)), z])
        if kind == "ols":
            b = np.linalg.lstsq(a, t, rcond=None)[0]
            out |= {i: (p, np.var(t - a @ b)) for i, p in zip(now.id, n @ b, strict=True)}
        else:
            w, ridge = np.zeros(a.shape[1]), np.append(0.0, np.ones(x.shape[1]))
            for _ in range(200):
                p = 1 / (1 + np.exp(-a @ w))
                w = w - np.linalg.solve(np.diag(ridge) + 0.5 * (a * (p * (1 - p))[:, None]).T @ a, ridge * w + 0.5 * a.T @ (p - t))
            out |= {i: (p, None) for i, p in zip(now.id, 1 / (1 + np.exp(-n @ w)), strict=True)}
    return out


@pytest.mark.parametrize("kind", ["ols", "logit"])
@pytest.mark.parametrize("features", [["a", "b"], ["a", "b", "c"], []])
def test_years_learn_from_all_years_before(spark, kind, features):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b = rng.normal(), rng.normal() * 50 + 300
        y = 0.8 * a - 0.01 * b + rng.normal()
        y = float(y > -3) if kind == "logit" else float(y)
        rows.append((i, date(2015, 1, 1) + timedelta(days=3 * i), None if i % 31 == 0 else y, float(a), None if i % 41 == 7 else float(b), float(2 * a + 1)))  # c is determined by a
    frame = spark.createDataFrame(rows, "id long, d date, y double, a double, b double, c double").repartition(4)
    got = {r["id"]: (r["p"], r["s2"]) for r in expanding.by_year(frame, "y", features, kind).collect()}
    want = yearly(rows, features, kind)
    assert set(got) == set(want) and len(want) > 600
    for i, (p, s2) in want.items():
        assert got[i][0] == pytest.approx(p, abs=1e-7)
        assert (got[i][1] is None) == (s2 is None) and (s2 is None or got[i][1] == pytest.approx(s2, rel=1e-7))


def test_expanding_with_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert walk.ols(empty, "symbol", "u", ["a"], "base").count() == 0
    few = spark.createDataFrame([(1, date(2020, 1, 1), 1.0, 2.0), (2, None, 1.0, 2.0), (3, date(2021, 1, 1), None, None)], "id long, d date, y double, a double")
    for kind in ("ols", "logit"):
        assert expanding.by_year(few, "y", ["a"], kind).count() == 0
    assert {r["p"] for r in expanding.by_year(few.limit(1).union(few.filter("id = 3").withColumn("a", F.lit(1.0))), "y", ["a"], least=1).collect()} == {1.0}


@pytest.mark.parametrize("lags", [None, 5])
def test_robust_errors_equal_the_kernel(spark, lags):
    rng = np.random.default_rng(2)
    rows = []
    for key, n in (("A", 300), ("B", 80)):
        x = rng.normal(size=(n, 3)) * [1, 5, 100] + [0, 3, 2000]
        y = x @ [0.2, 0.1, 0.001] + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
        rows += [(key, date(2020, 1, 1) + timedelta(days=t), float(y[t]), *map(float, x[t])) for t in range(n)]
    rows += [("A", date(2019, 1, 1), None, 1.0, 1.0, 1.0), (None, date(2019, 1, 1), 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, d date, y double, a double, b double, c double").repartition(3)
    got = {(r["k"], r["feature"]): (r["coefficient"], r["error"], r["p"]) for r in robust.regression(frame, "k", "y", ["a", "b", "c"], lags).collect()}
    for key in "AB":
        part = np.array([r[2:] for r in rows if r[0] == key and r[2] is not None])
        x = part[:, 1:]
        b, se = nm.robust(part[:, 0], (x - x.mean(0)) / x.std(0, ddof=1), lags)
        for i, f in enumerate("abc"):
            assert got[key, f] == pytest.approx((b[i + 1], se[i + 1], nm.two_sided(b[i + 1] / se[i + 1])), rel=1e-8)
    assert len(got) == 6


def test_fixed_effects_equal_a_regression_with_dummies(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "z", None]), date(2020, 1, 1), rng.gauss(0, 1), rng.gauss(5, 2) if i % 9 else None, rng.gauss(0, 1), 1.0) for i in range(400)] + [("alone", date(2020, 1, 1), 5.0, 9.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, d date, y double, a double, b double, flat double").repartition(3)
    got = {r["feature"]: r for r in robust.fixed_effects(frame, "g", "y", ["a", "b", "flat"]).collect()}
    for at, f in ((3, "a"), (4, "b")):
        part = [r for r in rows if r[at] is not None and r[0] != "alone"]
        all_ = [r[at] for r in rows if r[at] is not None]
        x = np.array([r[at] for r in part]) / np.std(all_, ddof=1)
        dummies = pd.get_dummies(pd.Series([r[0] or "none" for r in part]), drop_first=True).to_numpy(float)
        b, se = nm.robust(np.array([r[2] for r in part]), np.column_stack([x, dummies]))
        assert (got[f]["coefficient"], got[f]["error"]) == pytest.approx((b[1], se[1]), rel=1e-8)
        assert got[f]["n"] == len(all_)
    assert got["flat"]["coefficient"] is None and got["flat"]["n"] == 401


def test_normal_columns(spark):
    z = [-40.0, -8.3, -5.0, -1.96, -0.5, -0.1, 0.0, 1e-9, 0.3, 0.6628, 1.0, 2.5, 5.656, 5.658, 8.0, 30.0, 38.5, float("nan"), None]
    for r in spark.createDataFrame([(v,) for v in z], "z double").select("z", normal.erfc(F.col("z")).alias("e"), normal.cdf(F.col("z")).alias("p"), normal.two_sided(F.col("z")).alias("t"), normal.pdf(F.col("z")).alias("f")).collect():
        if r["z"] is None:
            assert r["e"] is None and r["p"] is None and r["t"] is None
        elif math.isnan(r["z"]):
            assert math.isnan(r["e"]) and math.isnan(r["p"])
        else:
            assert r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-12, abs=1e-300)
            assert r["p"] == pytest.approx(math.erfc(-r["z"] / math.sqrt(2)) / 2, rel=1e-11, abs=1e-300)
            assert (r["t"], r["f"]) == pytest.approx((nm.two_sided(r["z"]), math.exp(-r["z"] ** 2 / 2) / math.sqrt(2 * math.pi)), rel=1e-10, abs=1e-300)


def test_option_prices_as_columns(spark):
    rng = random.Random(1)
    rows = [(100 * math.exp(rng.gauss(0, 0.3)), 100.0, rng.random() * 2, 0.05 + rng.random()) for _ in range(200)]
    frame = spark.createDataFrame([*rows, (100.0, 90.0, 0.0, 0.2), (None, 90.0, 1.0, 0.2), (100.0, -1.0, 1.0, 0.2)], "f double, k double, t double, s double")
    got = options.priced(frame, "f", "k", "t", "s", rate=0.03).collect()
    for r, (f, k, t, s) in zip(got, rows, strict=False):
        assert (r["call"], r["put"]) == pytest.approx((float(nm.black76(f, k, t, 0.03, s)), float(nm.black76(f, k, t, 0.03, s, False))), abs=1e-11)
        for n, v in nm.greeks(f, k, t, 0.03, s).items():
            assert r[n] == pytest.approx(float(v), abs=1e-9)
    assert all(r[c] is None for r in got[-3:] for c in ("call", "put", "delta", "gamma", "vega", "theta"))


def test_placebos_by_refitting(spark):
    import hashlib

    rng = np.random.default_rng(9)
    rows = []
    for i in range(700):
        g, s, tone, size = rng.choice(["r", "p", None]), rng.choice(["A", "B", "C"]), rng.normal(), rng.normal()
        rows.append((i, date(2018, 1, 1) + timedelta(days=3 * i), None if g is None or g == "None" else str(g), str(s), float(0.4 * tone + 0.2 * size + rng.normal()) if i % 23 else None, float(size), float(tone), float(tone**2)))
    frame = spark.createDataFrame(rows, "id long, d date, g string, s string, u double, size double, tone double, square double").repartition(3)
    schemes = {"year": ["g", "year"], "company": ["g", "s"]}
    fits = placebo.refitted(frame, "u", ["size"], ["tone", "square"], schemes, replicates=20, least=100)
    got = {(r["scheme"], r["rep"]): (r["n"], r["mse"]) for r in fits.collect()}
    f = pd.DataFrame(rows, columns=["id", "d", "g", "s", "u", "size", "tone", "square"]).dropna(subset=["u"])
    f["year"] = [x.year for x in f.d]
    f["g"] = f.g.fillna("none")

    def error(x):
        total, n = 0.0, 0
        for y in sorted(set(x.year)):
            past, now = x[x.year < y], x[x.year == y]
            if len(past) >= 100:
                a, z = (np.column_stack([np.ones(len(q)), q[["size", "tone", "square"]]]) for q in (past, now))
                total, n = total + float(((now.u - z @ np.linalg.lstsq(a, past.u, rcond=None)[0]) ** 2).sum()), n + len(now)
        return n, total / n

    want = {(s, -1): error(f) for s in schemes}
    for name, keys in schemes.items():
        for rep in range(20):
            moved = f.copy()
            for _, part in f.groupby([k if k != "g" else "g" for k in keys]):
                order = sorted(part.id, key=lambda i: (hashlib.md5(f"7|{rep}|{i}".encode()).hexdigest(), i))
                source = part.set_index("id").loc[order, ["tone", "square"]].to_numpy()
                moved.loc[part.sort_values("id").index, ["tone", "square"]] = source
            want[name, rep] = error(moved)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-8) for k in want)
    share = {r["scheme"]: (r["real"], r["placebo"], r["share"]) for r in placebo.shares(fits).collect()}
    for s in schemes:
        placebos = [want[s, k][1] for k in range(20)]
        assert share[s] == pytest.approx((want[s, -1][1], np.mean(placebos), np.mean([p <= want[s, -1][1] for p in placebos])))
        assert share[s][2] < 0.2  # the tone matters


def test_permuted_keeps_rows_without_a_group(spark):
    rows = [(i, None if i % 3 == 0 else "g", float(i)) for i in range(30)]
    got = evaluate.permuted(spark.createDataFrame(rows, "id long, g string, v double"), ["v"], "g", "id", 1).collect()
    assert sorted(r["id"] for r in got) == list(range(30))
    assert sorted(r["v"] for r in got if r["g"] is None) == [float(i) for i in range(0, 30, 3)]


def test_ladder_by_period(spark):
    rng, rows = np.random.default_rng(5), []
    for t in range(300):
        rv = float(np.exp(rng.normal()))
        rows.append(("S", date(2020, 1, 1) + timedelta(days=t), rv, float(rv * np.exp(rng.normal() * 0.5)), float(np.exp(rng.normal() * 0.1)) if t % 50 else None))
    rows += [("T", date(2020, 1, 1) + timedelta(days=t), 1.0, 1.1, 0.9) for t in range(10)]
    frame = spark.createDataFrame(rows, "symbol string, d date, rv double, good double, base double")
    got = {(r["symbol"], r["period"], r["model"]): r for r in evaluate.ladder(frame, "symbol", "rv", ["base", "good"], "base", "2020-07-01").collect()}
    assert {k[0] for k in got} == {"S"} and len(got) == 4
    q = lambda rv, f: rv / f - math.log(rv / f) - 1
    for period in ("validation", "test"):
        part = [r for r in rows[:300] if r[4] and (r[1] < date(2020, 7, 1)) == (period == "validation")]
        a, b = np.array([q(r[2], r[3]) for r in part]), np.array([q(r[2], r[4]) for r in part])
        r = got["S", period, "good"]
        assert (r["dm"], r["p"]) == pytest.approx(nm.diebold_mariano(a - b, 5), rel=1e-8)
        assert (r["n"], r["qlike"], r["change"]) == pytest.approx((len(part), a.mean(), 100 * (a.mean() / b.mean() - 1)))
        assert got["S", period, "base"]["dm"] is None


def test_temperature(spark):
    rng = np.random.default_rng(6)
    for true in (0.4, 1.0, 6.0):
        z = rng.normal(size=(3000, 3)) * 2
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        y = (p.cumsum(1) < rng.random((3000, 1))).sum(1)
        frame = spark.createDataFrame([(*map(float, r * true), int(k)) for r, k in zip(z, y, strict=True)] + [(None, 1.0, 1.0, 0)], "a double, b double, c double, y int")
        got = evaluate.fit_temperature(frame, ["a", "b", "c"], "y")

        def loss(t, z=z * true, y=y):
            e = z / t
            return float((np.log(np.exp(e - e.max(1, keepdims=True)).sum(1)) + e.max(1) - e[np.arange(len(y)), y]).mean())

        a, b, phi = math.log(0.05), math.log(50), (math.sqrt(5) - 1) / 2
        for _ in range(80):
            c, d = b - phi * (b - a), a + phi * (b - a)
            a, b = (a, d) if loss(math.exp(c)) < loss(math.exp(d)) else (c, b)
        assert got == pytest.approx(math.exp((a + b) / 2), rel=1e-4) and got == pytest.approx(true, rel=0.15)
    with pytest.raises(ValueError, match="no row"):
        evaluate.fit_temperature(frame.filter("y > 9"), ["a", "b", "c"], "y")


def test_groups_of_networks_in_one_pass(spark):
    rng = random.Random(8)
    rows = [(g, f"{g}-{i}", n) for g in ("2020", "2021", "22") for i in range(40) for n in rng.sample("abcdefgh", rng.choice([1, 2, 3]))] + [("solo", "i", "a"), ("solo", "i", "b")]
    mentions = spark.createDataFrame(rows, "year string, item string, name string")
    edges = graph.grouped_comentions(mentions, "year")
    got = {(r["group"], r["metric"]): r["value"] for r in graph.grouped_metrics(edges).collect()}
    nodes = {(r["group"], r["name"]): r for r in graph.grouped_nodes(edges).collect()}
    for g in ("2020", "2021", "22", "solo"):
        own = graph.comentions(mentions.filter(F.col("year") == g).select("item", "name"))
        d = {r["name"]: r for r in graph.degrees(own).join(graph.triangles(own), "name").collect()}
        assert {n for x, n in nodes if x == g} == set(d)
        for n, r in d.items():
            assert (nodes[g, n]["degree"], nodes[g, n]["strength"], nodes[g, n]["triangles"], nodes[g, n]["clustering"]) == (r["degree"], r["strength"], r["triangles"], r["clustering"])
            assert nodes[g, n]["centrality"] == pytest.approx(r["degree"] / (len(d) - 1))
        t, s = graph.transitivity(own).first(), graph.summary(own, own.select(F.col("source").alias("name")).union(own.select("target"))).first()
        assert (got[g, "nodes"], got[g, "edges"], got[g, "transitivity"]) == pytest.approx((t["nodes"], t["edges"], t["transitivity"]))
        for m in ("density", "mean_degree", "mean_strength", "components", "giant"):
            assert got[g, m] == pytest.approx(s[m])
        a = graph.assortativity(own).first()[0]
        assert got[g, "assortativity"] == (None if a is None else pytest.approx(a))
        assert got[g, "clustering"] == pytest.approx(np.mean([r["clustering"] for r in d.values()]))


def returns(n=150):
    rng, rows = np.random.default_rng(7), []
    for k, symbol in enumerate(("A", "B", "C")):
        h = 1.0
        for t in range(n - 40 * k):
            r = rng.normal() * math.sqrt(h)
            h = 0.1 + 0.1 * r * r + 0.8 * h
            rows.append((symbol, date(2021, 1, 1) + timedelta(days=t), float(r)))
    return rows


@pytest.mark.parametrize("options_", [{"first": 60, "size": 25, "steps": 40}, {"first": 60, "size": 25, "steps": 40, "asymmetric": True}, {"fixed": (0.01, 0.05, 0.1, 0.85, 0.02, 1.0)}])
def test_variance_state_over_three_batches(spark, tmp_path, options_):
    rows = returns()
    frame = spark.createDataFrame(rows, "symbol string, d date, ret double")
    cuts = [date(2021, 1, 1), date(2021, 2, 20), date(2021, 4, 2), date(2022, 1, 1)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = frame.filter((F.col("d") >= a) & (F.col("d") < b))
        if k:  # days that were sent before come again, and a row without a return
            part = part.union(frame.filter(F.col("d") == a - timedelta(days=3))).union(frame.limit(1).select("symbol", F.lit(b).alias("d"), F.lit(None).cast("double")))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = garch.garch(live.file_stream(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/out", f"{tmp_path}/check", **options_)
        q.awaitTermination()
    got = {(r["symbol"], r["d"]): r["h"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    if "fixed" in options_:
        mu, omega, alpha, beta, gamma, start = options_["fixed"]
        for s in "ABC":
            own = [(d, r) for x, d, r in rows if x == s]
            h = nm.garch_filter(np.array([r for _, r in own]), mu, omega, alpha, beta, gamma, start)
            want |= {(s, d): h[t + 1] for t, (d, _) in enumerate(own)}
    else:
        want = {(r["symbol"], r["d"]): r["h"] for r in walk.garch(frame, "symbol", **options_).collect()}
    assert set(got) == set(want) and len(want) > 100
    assert max(abs(got[k] / want[k] - 1) for k in want) < 1e-9
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
