"""Regressions on expanding windows from prefix sums of moments: no row is copied for the blocks or years that learn from it.

The rows of a block are summed once (counts, sums and products); a window over a key's blocks, which are few, adds the sums of all
earlier blocks. One small system is solved for each block, and its coefficients join the block's own rows. Logistic
regressions take Newton steps: each is one aggregation of gradients and curvatures over all years at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import released, written

#: Eigenvalues of the correlation matrix below this share of the largest one count as zero, and so does the variance of a feature below this share of its square.
FLAT = 1e-11


def moments_of(rows: DataFrame, by: list[str], columns: list[str], known: Column) -> DataFrame:
    """(by, _n, _s0.., _q0_0..): count, sums and products of the known rows."""
    x = [F.when(known, F.col(c).cast("double")) for c in columns]
    sums = {"_n": F.count_if(known)} | {f"_s{i}": F.sum(c) for i, c in enumerate(x)} | {f"_q{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])


def accumulated(each: DataFrame, by: list[str], block: str, k: int, own: bool = False) -> DataFrame:
    """(by, block, n, sums, products) of each block's earlier blocks, from the moments of each (`moments_of` k columns)."""
    sums = ["_n", *[f"_s{i}" for i in range(k)], *[f"_q{i}_{j}" for i in range(k) for j in range(i, k)]]
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # without `by`, over one row for each block
    upto = {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums}
    of = lambda names: F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).cast("array<double>")
    packed = lambda head="": [F.col("_n").alias(f"{head}n"), of(n for n in sums if n[1] == "s").alias(f"{head}sums"), of(n for n in sums if n[1] == "q").alias(f"{head}products")]
    extra = packed("own_") if own else []
    added = each.select(*by, block, *extra, *[c.alias(n) for n, c in upto.items()])
    return added.select(*by, block, *packed(), *[n for n in ("own_n", "own_sums", "own_products") if own])


def prefix_moments(rows: DataFrame, by: list[str], block: str, columns: list[str], known: Column, own: bool = False) -> DataFrame:
    """(by, block, n, sums, products): of the known rows in each block's earlier blocks; `products` is the upper triangle, by rows. With `own`, also own_n, own_sums and own_products of the block itself."""
    return accumulated(moments_of(rows, [*by, block], columns, known), by, block, len(columns), own)


def solved(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(slopes per deviation, means, deviations, mean of the target, squared residuals) of the last column on the others; minimum norm, population deviations, a flat feature's deviation is 1."""
    k = len(sums)
    q = np.zeros((k, k))
    q[np.triu_indices(k)] = products
    square = np.maximum(np.diag(q) / n, 0)
    mean = sums / n
    cov = (q + np.triu(q, 1).T) / n - np.outer(mean, mean)
    var = np.diag(cov)[:-1]
    flat = var <= FLAT * square[:-1]
    sd = np.sqrt(np.where(flat, 1.0, var))
    x = np.where(flat[:, None] | flat[None, :], 0.0, cov[:-1, :-1]) / np.outer(sd, sd)
    xy = np.where(flat, 0.0, cov[:-1, -1]) / sd
    b = np.linalg.lstsq(x, xy, rcond=FLAT)[0] if k > 1 else np.zeros(0)
    return b, mean[:-1], sd, float(mean[-1]), n * max(float(cov[-1, -1] - 2 * b @ xy + b @ x @ b), 0.0)


def _fitted(moments: DataFrame, by: list[str], block: str, least: int, k: int) -> DataFrame:
    """(by, block, slopes, intercept, ssr, n) of the blocks that at least `least` rows come before."""
    key = ", ".join(f"`{c}` {t}" for c, t in moments.dtypes if c in (*by, block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                b, mean, sd, level, ssr = solved(r["n"], np.array(r["sums"], float), np.array(r["products"], float))
                w = b / sd
                out.append((*(r[c] for c in (*by, block)), w.tolist(), level - float(w @ mean), ssr, r["n"]))
            yield pd.DataFrame(out, columns=[*by, block, "_w", "_c", "_ssr", "_n"])

    return moments.filter(F.col("n") >= max(least, 1)).mapInPandas(run, f"{key}, _w array<double>, _c double, _ssr double, _n long")


def _dot(weights: str, features: list[str]) -> Column:
    return sum((F.element_at(weights, i + 1) * F.col(f) for i, f in enumerate(features)), F.lit(0.0))


def ols(rows: DataFrame, by: str, target: str, features: list[str], base: str, first: int = 120, size: int = 21, least: int = 1) -> DataFrame:
    """(by, d, u_hat, forecast) with forecast = base * exp(x'b + s2 / 2), of each row from the `first` one on, from the rows before its block with a known target.

    Rows without a feature or base take no part. Features are standardised on the learning rows (population deviation), which the
    slopes contain; s2 = SSR / (n - p - 1). Blocks of `size` rows; one that fewer than `least` known rows come before has no forecast. Without features the forecast is base * exp(mean + s2 / 2).
    """
    usable = rows.select(by, "d", target, base, *features).dropna(subset=[*features, base])
    names = [*features, target]
    centre = usable.groupBy(F.col(by).alias("_by")).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(names)])
    t = usable.withColumn("_t", F.row_number().over(Window.partitionBy(by).orderBy("d")) - 1).withColumn("_block", F.greatest(F.floor((F.col("_t") - first) / size), F.lit(-1)))
    t = t.join(centre, t[by].eqNullSafe(centre["_by"])).withColumns({f"_x{i}": F.col(c) - F.col(f"_m{i}") for i, c in enumerate(names)})  # small numbers: their products lose nothing
    shifted = [f"_x{i}" for i in range(len(names))]
    fit = _fitted(prefix_moments(t, [by], "_block", shifted, F.col(target).isNotNull()), [by], "_block", least, len(features))
    fit = fit.withColumnsRenamed({by: "_key", "_block": "_at"})
    now = t.filter("_block >= 0").join(fit, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    u = F.col("_c") + _dot("_w", shifted[:-1]) + F.col(f"_m{len(features)}")
    s2 = F.col("_ssr") / F.greatest(F.col("_n") - len(features) - 1, F.lit(1))
    return now.select(by, "d", u.alias("u_hat"), (F.col(base) * F.exp(u + s2 / 2)).alias("forecast"))


def _yearly(rows: DataFrame, target: str, features: list[str]) -> DataFrame:
    y = rows.select("id", "d", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    return y.dropna(subset=["d", *[f"_x{i}" for i in range(len(features))]]).withColumn("year", F.year("d"))


def by_year(rows: DataFrame, target: str, features: list[str], kind: str = "ols", least: int = 50, c: float = 0.5) -> DataFrame:
    """(id, p, s2): predictions for each year from all earlier years with at least `least` rows whose target is known.

    Rows without a feature or a day take no part; rows without a target are predicted but not learned from. `ols` is the minimum-norm fit on features
    standardised on the learning rows, s2 the population variance of its residuals; without features p and s2 are 0. `logit` minimises |w|² / 2 + c Σ log loss on the
    standardised features with a free intercept (s2 is null); without features p is the mean of the learning rows.
    """
    y, k = _yearly(rows, target, features), len(features)
    x = [f"_x{i}" for i in range(k)]
    means = y.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in (*x, "_y")]).first()  # a number for each column
    y = y.withColumns({n: F.col(n) - means[n] for n in x})
    moments = prefix_moments(y.withColumn("_u", F.col("_y") - means["_y"]), [], "year", [*x, "_u"], F.col("_y").isNotNull())
    null = F.lit(None).cast("double")
    if not features:
        mean = moments.filter(F.col("n") >= least).select("year", (F.col("sums")[0] / F.col("n") + means["_y"]).alias("_mean"))
        return y.join(mean, "year").select("id", *((F.lit(0.0).alias("p"), F.lit(0.0).alias("s2")) if kind == "ols" else (F.col("_mean").alias("p"), null.alias("s2"))))
    if kind == "ols":
        fit = _fitted(moments, [], "year", least, k)
        return y.join(fit, "year").select("id", (F.col("_c") + _dot("_w", x) + means["_y"]).alias("p"), (F.col("_ssr") / F.col("_n")).alias("s2"))
    weights = logit_weights(y.filter("_y is not null").select("year", "_y", *x), moments.filter(F.col("n") >= least), x, c)
    found = y.sparkSession.createDataFrame([(year, w[1:].tolist(), float(w[0])) for year, w in weights.items()], "year int, _w array<double>, _c double")
    return y.join(F.broadcast(found), "year").select("id", (1 / (1 + F.exp(-(F.col("_c") + _dot("_w", x))))).alias("p"), null.alias("s2"))


def logit_weights(rows: DataFrame, moments: DataFrame, x: list[str], c: float, rounds: int = 50) -> dict[int, np.ndarray]:
    """(intercept, weights of the unscaled features) for each year of `moments`, by Newton steps. A step is one pass over the rows; what meets in the driver is a gradient and a matrix for each year."""
    scale = {}
    for r in moments.collect():  # one row for each year
        _, mean, sd, _, _ = solved(r["n"], np.array(r["sums"]), np.array(r["products"]))
        scale[r["year"]] = (mean, sd)
    k, w = len(x), {year: np.zeros(len(x) + 1) for year in scale}
    ridge, active = np.append(0.0, np.ones(k)), set(scale)
    kept = written(rows, "logit")

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {year: np.zeros((k + 1) * (k + 2)) for year in active}
        for batch in batches:
            year, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = np.column_stack([v.to_numpy() for v in batch.columns[2:]])
            for of in active:
                at = year < of
                if at.any():
                    a = np.column_stack([np.ones(at.sum()), (raw[at] - scale[of][0]) / scale[of][1]])
                    p = 1 / (1 + np.exp(-np.clip(a @ w[of], -30, 30)))
                    total[of][: k + 1] += a.T @ (p - y[at])
                    total[of][k + 1 :] += ((a * (p * (1 - p))[:, None]).T @ a).ravel()
        if total:
            n = (k + 1) * (k + 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), n), pa.int32()), pa.array(np.tile(np.arange(n), len(total)), pa.int32()), pa.array(np.concatenate(list(total.values())))], names=["year", "k", "v"])

    for _ in range(rounds):
        if not active:
            break
        got = {year: np.zeros((k + 1) * (k + 2)) for year in active}
        for r in kept.mapInArrow(gradients, "year int, k int, v double").groupBy("year", "k").agg(F.sum("v").alias("v")).collect():
            got[r["year"]][r["k"]] = r["v"]
        for year, v in got.items():
            g, h = ridge * w[year] + c * v[: k + 1], np.diag(ridge + 1e-12) + c * v[k + 1 :].reshape(k + 1, k + 1)
            step = np.linalg.solve(h, g)
            w[year] = w[year] - step
            if np.abs(step).max() < 1e-10:
                active = active - {year}
    released(kept)
    out = {}
    for year, v in w.items():
        mean, sd = scale[year]
        out[year] = np.append(v[0] - float((v[1:] / sd) @ mean), v[1:] / sd)
    return out
