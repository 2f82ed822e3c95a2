"""Robust standard errors from moments: rows are reduced where they are, no task holds a series or a panel.

Two passes over the rows: one for the moments that give the coefficients, one for the middle matrix of the
sandwich, with residuals and leverages as columns. What is solved in Python are a few numbers for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal


def _sum(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def regression(rows: DataFrame, by: str, y: str, features: list[str], lags: int | None = None) -> DataFrame:
    """(by, feature, coefficient, error, p): per standard deviation (of the sample) of each feature; HC3 errors, or Newey-West with `lags`.

    Rows with a null (or NaN) among by's series, target and features take no part. A feature that does not vary, or that others determine, shares the minimum-norm solution.
    p is two-sided normal. With `lags`, a key's rows are ordered by d.
    """
    k = len(features)
    clean = rows.select(by, "d", y, *features).dropna(subset=[by, "d", y, *features])
    scale = [F.coalesce(F.nullif(F.stddev_samp(f), F.lit(0.0)), F.lit(1.0)) for f in features]
    centre = clean.groupBy(F.col(by).alias("_by")).agg(F.array(*map(F.avg, features)).alias("_m"), F.array(*scale).alias("_sd"), F.avg(y).alias("_my"))
    z = clean.join(centre, clean[by] == centre["_by"]).select(by, "d", (F.col(y) - F.col("_my")).alias("_y"), *[((F.col(f) - F.col("_m")[i]) / F.col("_sd")[i]).alias(f"_z{i}") for i, f in enumerate(features)])
    zs = [F.col(f"_z{i}") for i in range(k)]
    moments = z.groupBy(F.col(by).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(a * b) for a in zs for b in zs]).alias("_zz"), F.array(*[F.sum(a * F.col("_y")) for a in zs]).alias("_zy"))
    kind = dict(clean.dtypes)[by]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                inverse = np.linalg.pinv(np.array(r["_zz"]).reshape(k, k), rcond=1e-12)
                out.append((r["_key"], r["_n"], inverse.ravel().tolist(), (inverse @ np.array(r["_zy"])).tolist()))
            yield pd.DataFrame(out, columns=["_key", "_n", "_inv", "_b"])

    # The features are centred, so the intercept is apart: leverage = 1 / n + z' inv z.
    fit = moments.mapInPandas(solve, f"_key {kind}, _n long, _inv array<double>, _b array<double>")
    e = F.col("_y") - _sum([F.col("_b")[i] * zs[i] for i in range(k)])
    lever = 1 / F.col("_n") + _sum([zs[i] * zs[j] * F.col("_inv")[i * k + j] for i in range(k) for j in range(k)])
    each = z.join(fit, z[by] == fit["_key"])
    n_inv = [F.first("_n").alias("_n"), F.first("_inv").alias("_inv"), F.first("_b").alias("_b")]
    ones = [F.lit(1.0), *zs]  # the middle matrix keeps the intercept's row and column: scores need not sum to zero
    if lags is None:
        w = F.pow(e / F.when(1 - lever > 1e-12, 1 - lever), 2)  # a row that decides its own fit has no residual
        meat = each.groupBy(by).agg(*n_inv, F.array(*[F.coalesce(F.sum(a * b * w), F.lit(0.0)) for a in ones for b in ones]).alias("_meat"))
    else:
        scored = each.select(by, "d", "_n", "_inv", "_b", *[(a * e).alias(f"_s{i}") for i, a in enumerate(ones)])
        order, s = Window.partitionBy(by).orderBy("d"), [f"_s{i}" for i in range(k + 1)]
        lagged = scored.withColumns({f"{n}_{j}": F.lag(n, j).over(order) for n in s for j in range(1, lags + 1)})
        product = lambda a, b: F.sum(F.col(a) * F.col(b)) + _sum([(1 - j / (lags + 1)) * (F.coalesce(F.sum(F.col(a) * F.col(f"{b}_{j}")), F.lit(0.0)) + F.coalesce(F.sum(F.col(b) * F.col(f"{a}_{j}")), F.lit(0.0))) for j in range(1, lags + 1)])
        meat = lagged.groupBy(by).agg(*n_inv, F.array(*[product(a, b) for a in s for b in s]).alias("_meat"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                inverse = np.zeros((k + 1, k + 1))
                inverse[0, 0], inverse[1:, 1:] = 1 / r["_n"], np.array(r["_inv"]).reshape(k, k)
                cover = inverse @ np.array(r["_meat"]).reshape(k + 1, k + 1) @ inverse
                out += [(r[by], f, float(b), float(np.sqrt(max(v, 0.0)))) for f, b, v in zip(features, r["_b"], np.diag(cover)[1:], strict=True)]
            yield pd.DataFrame(out, columns=[by, "feature", "coefficient", "error"])

    done = meat.select(by, "_n", "_inv", "_b", "_meat").mapInPandas(finish, f"{by} {kind}, feature string, coefficient double, error double")
    return done.withColumn("p", normal.two_sided(F.try_divide("coefficient", "error")))


def fixed_effects(rows: DataFrame, group: str, y: str, features: list[str]) -> DataFrame:
    """(feature, coefficient, error, p, n): one regression with group effects for each feature, HC3 errors, per standard deviation (of the sample) of the feature.

    Within-group centring takes the place of the group columns: the leverage of a row is 1 / group size + x² / Σ x², with x centred. Rows
    with a null among target and feature take no part in that feature's regression; rows without a group form one. A row
    alone in its group decides its own effect and adds nothing. A feature that varies in no group has null figures.
    """
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long_ = rows.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), x.alias("z")).select("g", "y", "z.*").dropna(subset=["y", "x"])
    n = F.count(F.lit(1))
    own = long_.groupBy("feature", "g").agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (n * F.var_pop("x")).alias("xx"), (n * F.covar_pop("x", "y")).alias("xy"))
    all_ = own.groupBy("feature").agg(F.sum("n").alias("total"), F.sum("xx").alias("sxx"), F.sum("xy").alias("sxy"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("mean"))
    between = own.join(all_.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("mx") - F.col("mean"), 2)).alias("between"))
    flat = F.col("sxx") <= 1e-12 * (F.col("sxx") + F.col("between"))
    fit = all_.join(between, "feature").select("feature", "total", F.when(~flat, F.col("sxx")).alias("sxx"), F.when(~flat, F.col("sxy") / F.col("sxx")).alias("b"), F.sqrt((F.col("sxx") + F.col("between")) / (F.col("total") - 1)).alias("sd"))
    stats = own.select(F.col("feature").alias("f"), F.col("g").alias("h"), "n", "mx", "my").join(fit.withColumnRenamed("feature", "f"), "f")
    each = long_.join(stats, (F.col("feature") == F.col("f")) & F.col("g").eqNullSafe(F.col("h")))
    xc, yc = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    left = 1 - 1 / F.col("n") - xc * xc / F.col("sxx")
    part = F.pow(xc * (yc - F.col("b") * xc) / F.when(left > 1e-12, left), 2)
    out = each.groupBy("feature").agg(F.first("b").alias("b"), F.first("sxx").alias("sxx"), F.first("sd").alias("sd"), F.first("total").alias("n"), F.coalesce(F.sum(part), F.lit(0.0)).alias("meat"))
    coefficient, error = F.col("b") * F.col("sd"), F.sqrt("meat") / F.col("sxx") * F.col("sd")
    return out.select("feature", coefficient.alias("coefficient"), error.alias("error"), normal.two_sided(F.try_divide(coefficient, error)).alias("p"), "n")
