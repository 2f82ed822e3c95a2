"""GARCH variances of a stream: each symbol keeps its last variance and shock between batches, and fits its parameters anew at block borders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import numeric as nm

OUT = "symbol string, d date, h double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GarchState(StatefulProcessor):
    """State of a symbol: rows so far, the last day, the variance of the next day and the parameters; and its returns, which only a fit reads.

    `fixed` gives (mu, omega, alpha, beta, gamma, first variance); then nothing is fitted and no return is kept. Otherwise nothing comes out before row
    `first`; there and after every `size` rows the parameters are fitted on all returns before that row and the filter runs over them once.
    """

    def __init__(self, first: int = 500, size: int = 21, asymmetric: bool = False, steps: int = 200, fixed: tuple[float, ...] | None = None):
        self.first, self.size, self.asymmetric, self.steps, self.fixed = first, size, asymmetric, steps, fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "n long, d date, h double, mu double, omega double, alpha double, beta double, gamma double")
        self.past = handle.getListState("past", "ret double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).dropna(subset=["d", "ret"]).sort_values(["d", "ret"])
        if self.now.exists():
            n, last, h, *p = self.now.get()
        elif self.fixed:
            n, last, p, h = 0, None, list(self.fixed[:5]), float(self.fixed[5])
        else:
            n, last, h, p = 0, None, float("nan"), [float("nan")] * 5
        new = new[~new.d.duplicated()]
        if last is not None:
            new = new[new.d > last]
        if new.empty:
            return
        days, returns, out = new.d.tolist(), new.ret.to_numpy(float), []
        seen = None if self.fixed else []  # this batch's returns, added to the list at the end
        before: np.ndarray | None = None
        for d, r in zip(days, returns.tolist(), strict=True):
            if seen is not None and n >= self.first and (n - self.first) % self.size == 0:
                if before is None:
                    before = np.array([x[0] for x in self.past.get()], float)
                past = np.concatenate([before, seen])
                fit = nm.garch_fit(past, self.asymmetric, self.steps)
                p = [fit["mu"], fit["omega"], fit["alpha"], fit["beta"], fit["gamma"]]
                h = float(nm.garch_filter(past, *p, float(np.mean((past - p[0]) ** 2)))[-1])
            if seen is not None:
                seen.append(r)
            if self.fixed or n >= self.first:
                e = r - p[0]
                h = p[1] + (p[2] + p[4] * (e < 0)) * e * e + p[3] * h
                out.append((key[0], d, h))
            n, last = n + 1, d
        self.now.update((n, last, h, *p))
        if seen:
            self.past.appendList([(x,) for x in seen])
        if out:
            yield pd.DataFrame(out, columns=["symbol", "d", "h"])

    def close(self) -> None:
        pass


def garch(rows: DataFrame, target: str, checkpoint: str, **options):
    """Starts a stream of (symbol, d, ret) that adds (symbol, d, h) to `target`: h is the variance of the day after d, from all returns up to d.

    Days of a symbol come in order over the batches; one that is not after the last day seen is a repeat and is left out. Options are those of GarchState.
    """
    spark = rows.sparkSession
    states = rows.select("symbol", "d", "ret").groupBy("symbol").transformWithStateInPandas(GarchState(**options), OUT, "Append", "None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the only store that keeps such states; the query takes it over at its start
    try:
        return states.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
