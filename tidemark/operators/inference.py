"""Bootstraps and the confidence set, for series of daily rows.

A series of daily losses is small (a row for each day), so one key's rows meet in one task; keys run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as nm

from .robust import fixed_effects, regression  # noqa: F401


def contrasts(rows: DataFrame, by: str, pairs: list[tuple[str, str]], draws: int = 2000, block: int = 10, seed: int = 0) -> DataFrame:
    """(by, better, base, change, lo, hi, p, verdict) of loss columns: block-bootstrap interval of the mean difference; better if it lies below zero, worse above."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("d"), []
        for a, b in pairs:
            d = pdf[a].to_numpy(float) - pdf[b].to_numpy(float)
            lo, hi = nm.block_interval(d, draws, block, seed)
            out.append((key[0], a, b, 100 * d.mean() / pdf[b].mean(), lo, hi, nm.diebold_mariano(d)[1], "better" if hi < 0 else "worse" if lo > 0 else "no difference"))
        return pd.DataFrame(out, columns=[by, "better", "base", "change", "lo", "hi", "p", "verdict"])

    columns = sorted({c for p in pairs for c in p})
    return rows.select(by, "d", *columns).dropna().groupBy(by).applyInPandas(run, f"{by} string, better string, base string, change double, lo double, hi double, p double, verdict string")


def cluster_bootstrap(rows: DataFrame, by: str, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of 100 * (sum a / sum b - 1) over days drawn with replacement. Days are summed before any row moves to Python."""
    days = rows.groupBy(by, "d").agg(F.sum(a).alias("a"), F.sum(b).alias("b"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("d")[["a", "b"]].to_numpy(float)
        s = x[np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))].sum(1)
        r = 100 * (s[:, 0] / s[:, 1] - 1)
        return pd.DataFrame({by: [key[0]], "change": [100 * (x[:, 0].sum() / x[:, 1].sum() - 1)], "lo": [np.percentile(r, 2.5)], "hi": [np.percentile(r, 97.5)]})

    return days.groupBy(by).applyInPandas(run, f"{by} string, change double, lo double, hi double")


def confidence_sets(rows: DataFrame, by: str, models: list[str], level: float = 0.1, draws: int = 2000) -> DataFrame:
    """(by, model): the models that survive the range test."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        alive = nm.confidence_set(pdf.sort_values("d")[models].to_numpy(float), level, draws)
        return pd.DataFrame({by: key[0], "model": [models[i] for i in alive]})

    return rows.select(by, "d", *models).dropna().groupBy(by).applyInPandas(run, f"{by} string, model string")


def paired_f1(counts: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of the macro-F1 difference of two predictions, from counts (y, p1, p2, n) drawn anew: a table of at most classes cubed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf[["y", "p1", "p2"]].to_numpy().max()) + 1
        n = pdf.n.to_numpy()
        draw = np.vstack([n, np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws)])

        def f1(p: str) -> np.ndarray:
            out = np.zeros(len(draw))
            for c in range(k):
                t, s = (pdf.y == c).to_numpy(), (pdf[p] == c).to_numpy()
                out += 2 * draw[:, t & s].sum(1) / np.maximum(draw[:, t].sum(1) + draw[:, s].sum(1), 1)
            return out / k

        d = f1("p2") - f1("p1")
        return pd.DataFrame({"difference": [d[0]], "lo": [np.percentile(d[1:], 2.5)], "hi": [np.percentile(d[1:], 97.5)]})

    return counts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "difference double, lo double, hi double")
