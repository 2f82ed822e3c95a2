"""Walk-forward estimation. Each block of rows is a task of its own that sees only earlier rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric as nm

from .expanding import by_year, ols  # noqa: F401


def blocks(rows: DataFrame, by: str, first: int, size: int) -> DataFrame:
    """Every row for every block that may learn from it or is forecast in it: (by, block start, t, ...).

    The copies grow with the number of blocks, as expanding windows do; one series is bounded by its days.
    """
    t = rows.withColumn("t", F.row_number().over(Window.partitionBy(by).orderBy("d")) - 1)
    n = t.groupBy(by).agg(F.max("t").alias("last"))
    starts = n.filter(F.col("last") >= first).select(by, F.explode(F.sequence(F.lit(first), F.col("last"), F.lit(size))).alias("start"))
    return t.join(starts, by).filter(F.col("t") < F.col("start") + size)


def logit(x: np.ndarray, y: np.ndarray, c: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first, not penalised) of the least ½|w|² + C Σ log loss, by Newton steps."""
    a, b = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.append(0.0, np.ones(x.shape[1]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = ridge * b + c * a.T @ (p - y)
        h = np.diag(ridge + 1e-12) + c * (a * (p * (1 - p))[:, None]).T @ a
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    return b


def garch(returns: DataFrame, by: str, first: int = 500, size: int = 21, asymmetric: bool = False, steps: int = 200) -> DataFrame:
    """(by, d, h): one-step variances, with parameters fitted on the rows before each block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r, past = pdf.ret.to_numpy(float), int((pdf.t < key[1]).sum())
        p = nm.garch_fit(r[:past], asymmetric, steps)
        e0 = float(np.mean((r[:past] - p["mu"]) ** 2))
        h = nm.garch_filter(r, p["mu"], p["omega"], p["alpha"], p["beta"], p["gamma"], e0)
        return pd.DataFrame({by: key[0], "d": pdf.d.to_numpy()[past:], "h": h[past + 1 :]})

    return blocks(returns.select(by, "d", "ret").dropna(), by, first, size).groupBy(by, "start").applyInPandas(run, f"{by} string, d date, h double")


def garch_fixed(returns: DataFrame, by: str, mu: float, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """The variance recursion with given parameters, as a fold over each key's ordered returns: no Python."""
    seq = returns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("d", "ret"))).alias("s"))
    step = lambda acc, x: F.concat(acc, F.array(F.lit(omega) + F.lit(alpha) * F.pow(x["ret"] - mu, 2) + F.lit(beta) * F.element_at(acc, -1)))
    folded = seq.select(by, "s", F.aggregate("s", F.array(F.lit(float(start))), step).alias("h"))
    return folded.select(by, F.posexplode("s").alias("i", "x"), "h").select(by, F.col("x.d").alias("d"), F.get("h", F.col("i") + 1).alias("h"))


def rolling_connectedness(panel: DataFrame, nodes: list[str], window: int = 250, step: int = 5, horizon: int = 10) -> DataFrame:
    """(d, total, node, net): spillover index of every window of rows, one task each, and what each node gives less what it takes, in per cent."""
    t = panel.withColumn("t", F.row_number().over(Window.orderBy("d")) - 1)
    last = t.agg(F.max("t")).first()[0]
    if last is None or last + 1 < window:
        return panel.sparkSession.createDataFrame([], "d date, total double, node string, net double")
    ends = panel.sparkSession.range(window - 1, last + 1, step).select(F.col("id").alias("end"))
    rows = t.withColumn("end", F.explode(F.expr(f"filter(sequence(0, {window - 1}), k -> (t + k - {window - 1}) % {step} = 0 and t + k <= {last} and t + k >= {window - 1})"))).withColumn("end", F.col("t") + F.col("end"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        theta = nm.gfevd(pdf[nodes].to_numpy(float), horizon)
        return pd.DataFrame({"d": pdf.d.iloc[-1], "total": 100 * (1 - np.trace(theta) / len(nodes)), "node": nodes, "net": 100 * (theta.sum(0) - theta.sum(1))})

    return rows.join(ends, "end", "left_semi").groupBy("end").applyInPandas(run, "d date, total double, node string, net double")


def _moments(rows: DataFrame, by: str, target: str, features: list[str]) -> DataFrame:
    """Counts, means and covariances of features and target: a row of a few numbers for each key, combined before the shuffle."""
    known = rows.dropna(subset=[target, *features])
    cols = [*features, target]
    cov = F.array(*[F.covar_pop(a, b) for a in cols for b in cols])
    return known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, cols)).alias("mean"), cov.alias("cov"))


def _solved(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Slopes on standardised features, means, deviations, intercept and residual variance."""
    mean, cov = np.array(row["mean"]), np.array(row["cov"]).reshape(k + 1, k + 1)
    sd = np.sqrt(np.diag(cov)[:k])
    sd = np.where(sd > 0, sd, 1.0)
    b = np.linalg.lstsq(cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd, rcond=None)[0]
    ssr = row["n"] * max(cov[k, k] - float(b @ (cov[:k, k] / sd)), 0.0)
    return b, mean[:k], sd, float(mean[k]), ssr / max(row["n"] - k - 1, 1)


def latest(rows: DataFrame, by: str, target: str, features: list[str], base: str) -> DataFrame:
    """(by, d, u_hat, forecast) of each key's last row with features, from all rows whose target is known.

    forecast = base * exp(u + s2 / 2), as in `ols`. Only moments and one row of each key move.
    """
    usable = rows.dropna(subset=[*features, base])
    now = usable.groupBy(by).agg(F.max("d").alias("d"), F.max_by(F.array(*features), "d").alias("x"), F.max_by(base, "d").alias("base"))
    joined = _moments(usable, by, target, features).join(now, by)
    kind = dict(rows.dtypes)[by]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                b, mean, sd, level, s2 = _solved(r, len(features))
                u = level + float(b @ ((np.array(r["x"]) - mean) / sd))
                out.append((r[by], r["d"], u, r["base"] * np.exp(u + s2 / 2)))
            yield pd.DataFrame(out, columns=[by, "d", "u_hat", "forecast"])

    return joined.mapInPandas(run, f"{by} {kind}, d date, u_hat double, forecast double")


def unit_effects(rows: DataFrame, by: str, target: str, features: list[str]) -> DataFrame:
    """(by, feature, coefficient): the regression on all rows, per standard deviation (of the population) of each feature."""
    kind = dict(rows.dtypes)[by]

    def run(batches):
        for pdf in batches:
            out = [(r[by], f, float(c)) for r in pdf.to_dict("records") for f, c in zip(features, _solved(r, len(features))[0], strict=True)]
            yield pd.DataFrame(out, columns=[by, "feature", "coefficient"])

    return _moments(rows, by, target, features).mapInPandas(run, f"{by} {kind}, feature string, coefficient double")
