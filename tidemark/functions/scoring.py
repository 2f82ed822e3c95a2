"""Batch scoring behind a protocol: anything with `logits(texts, targets)` can score a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate

LABELS = ("positive", "negative", "neutral")


class Scorer(Protocol):
    def logits(self, texts: Sequence[str], targets: Sequence[str]) -> np.ndarray:
        """Rows of (positive, negative, neutral)."""


class LexiconScorer:
    """A deterministic scorer from two word lists: the stand-in where no trained model is at hand."""

    def __init__(self, positive: Sequence[str], negative: Sequence[str]):
        self.positive, self.negative = frozenset(positive), frozenset(negative)

    def logits(self, texts: Sequence[str], targets: Sequence[str]) -> np.ndarray:
        words = [(t or "").lower().split() for t in texts]
        p, n = (np.array([sum(w.strip(".,;:!?") in s for w in ws) for ws in words], float) for s in (self.positive, self.negative))
        return np.column_stack([p, n, np.full(len(words), 0.5)])


def first_model(*builds: Callable[[], Scorer]) -> Callable[[], Scorer]:
    """Builds the first model that can be built; the last one's failure is raised."""

    def build() -> Scorer:
        for one in builds[:-1]:
            try:
                return one()
            except Exception:  # noqa: BLE001  weights that are not there, a library that is missing
                continue
        return builds[-1]()

    return build


def probabilities(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((z - z.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def scored(rows: DataFrame, text: str, build: Callable[[], Scorer], tag: str, target: str = "", temperature: float = 1.0, batch: int = 64, target_column: str | None = None) -> DataFrame:
    """Adds z_<tag>_<label>, p_<tag>_<label>, sent_<tag> and label_<tag>; null for a null text. Each distinct text is scored once for each target; the model is built once for each task.

    The target is the same for all rows, or each row's own in `target_column` (a null one is empty).
    """
    names = [f"{k}_{tag}_{n}" for k in "zp" for n in LABELS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for b in batches:
            z = np.concatenate([model.logits(b._text[i : i + batch].tolist(), b._target[i : i + batch].tolist()) for i in range(0, len(b), batch)]) if len(b) else np.zeros((0, 3))
            p = probabilities(z, temperature)
            yield pd.DataFrame(dict(zip(["_text", "_target", *names], [b._text, b._target, *z.T, *p.T], strict=True)))

    own = F.coalesce(F.col(target_column), F.lit("")) if target_column else F.lit(target)
    distinct = rows.select(F.col(text).alias("_text"), own.alias("_target")).filter(F.col("_text").isNotNull()).distinct()
    got = distinct.mapInPandas(run, "_text string, _target string, " + ", ".join(f"{n} double" for n in names))
    out = rows.join(got, (F.col(text) == F.col("_text")) & (own == F.col("_target")), "left").drop("_text", "_target")
    best = evaluate.argmax([F.col(f"p_{tag}_{n}") for n in LABELS], list(LABELS))
    return out.withColumns({f"sent_{tag}": F.col(f"p_{tag}_positive") - F.col(f"p_{tag}_negative"), f"label_{tag}": F.when(F.col(f"p_{tag}_positive").isNotNull(), best)})


def fit_temperature(z: np.ndarray, y: np.ndarray, low: float = 0.05, high: float = 50.0, rounds: int = 80) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""
    loss = lambda t: float(-np.log(probabilities(z, np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())
    a, b, g = np.log(low), np.log(high), (5**0.5 - 1) / 2
    for _ in range(rounds):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
