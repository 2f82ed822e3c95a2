"""Price bars: adjustment, realised variance, heterogeneous lags. Every window is within a symbol."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(by: str = "symbol") -> Window:
    return Window.partitionBy(by).orderBy("d")


def usable(bars: DataFrame, index_prefix: str = "^") -> DataFrame:
    """Bars with volume (indices excepted) and a range, filtered before any lag."""
    return bars.filter(((F.coalesce(F.col("v"), F.lit(0.0)) > 0) | F.col("symbol").startswith(index_prefix)) & (F.col("h") > F.col("l")))


def adjusted(bars: DataFrame, factor: Column) -> DataFrame:
    """Prices times a dividend factor; a missing factor is 1."""
    f = F.coalesce(factor, F.lit(1.0))
    return bars.withColumns({c: F.col(c) * f for c in "ohlc"})


def realised(bars: DataFrame) -> DataFrame:
    """ret, overnight, park_var, rv and rv_target; the first row of each symbol has no return and is dropped."""
    w = order()
    lc = F.lag("c").over(w)
    steps = bars.withColumn("ret", 100 * F.ln(F.col("c") / lc)).withColumn("overnight", F.ln(F.col("o") / lc)).withColumn("park_var", F.pow(F.ln(F.col("h") / F.col("l")), 2) / (4 * math.log(2)))
    rv = steps.filter(F.col("ret").isNotNull()).withColumn("rv", 1e4 * (F.pow("overnight", 2) + F.col("park_var")))
    return rv.withColumn("rv_target", F.lead("rv").over(w))


def full_mean(value: str, n: int, w: Window) -> Column:
    """Rolling mean of `n` rows; null unless all are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def har(rv: DataFrame) -> DataFrame:
    """Logs of the daily, weekly and monthly mean variance, and the weekday; ex_div where the rows have a dividend."""
    w = order()
    if "dividend" in rv.columns:
        rv = rv.withColumn("ex_div", F.coalesce(F.col("dividend") > 0, F.lit(False)).cast("long"))
    return rv.withColumns({"lrv_d": F.ln("rv"), "lrv_w": F.ln(full_mean("rv", 5, w)), "lrv_m": F.ln(full_mean("rv", 22, w)), "dow": F.weekday("d").cast("long")})


def forward_mean(rv: DataFrame, n: int = 21, least: int = 15) -> DataFrame:
    frame = order().rowsBetween(1, n)
    return rv.withColumn("rv_fwd", F.when(F.count("rv").over(frame) >= least, F.avg("rv").over(frame)))


def filled(rows: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """Forward fill."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(order(by).rowsBetween(Window.unboundedPreceding, 0)))


def cumulative(rows: DataFrame, value: str, out: str, by: str = "symbol") -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(order(by).rowsBetween(Window.unboundedPreceding, 0)))


def panel(rv: DataFrame, nodes: list[str]) -> DataFrame:
    """ln rv by day and node; rv of 0 is missing and incomplete days are dropped."""
    return rv.withColumn("x", F.when(F.col("rv") > 0, F.ln("rv"))).groupBy("d").pivot("symbol", nodes).agg(F.first("x")).dropna()
