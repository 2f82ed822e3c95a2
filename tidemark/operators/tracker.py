"""The live tables: forecasts of the next day, the tracker of past ones and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bars, evaluate
from .align import business_day_add


def table(rv: DataFrame, news: DataFrame | None = None, market: DataFrame | None = None) -> DataFrame:
    """Features by day: variance lags, market variance carried forward, news counts (0 without news)."""
    out = bars.har(rv)
    if market is not None:
        out = bars.filled(out.join(market.select("d", F.ln("rv").alias("lrv_mkt")), "d", "left"), "lrv_mkt")
    if news is not None:
        counts = [c for c in news.columns if c not in ("d", "s", "sent")]
        out = out.join(news, "d", "left").fillna(0, counts)
    return out


def tracked(forecasts: DataFrame, by: str, models: list[str], test_start: str) -> DataFrame:
    """One row for the day that each forecast is for, with what was realised; the last is pending and falls on the next weekday."""
    w = bars.order(by)
    day = F.lead("d").over(w)
    return forecasts.select(by, F.coalesce(day, business_day_add(F.col("d"))).alias("d"), F.lead("rv").over(w).alias("realised"), *models, day.isNull().alias("pending"), F.when(F.coalesce(day, business_day_add(F.col("d"))) >= test_start, "test").otherwise("validation").alias("period"))


def summary(tracker: DataFrame, by: str, models: list[str], base: str, least: int = 10) -> DataFrame:
    """Mean loss by period and model with the change to the base; periods with fewer than `least` days are left out."""
    known = tracker.filter("not pending")
    long_ = known.select(by, "period", "realised", F.col(base).alias("_b"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("f")) for m in models])).alias("x")).select(by, "period", "realised", "_b", "x.*")
    loss, own = evaluate.qlike(F.col("realised"), F.col("f")), evaluate.qlike(F.col("realised"), F.col("_b"))
    g = long_.filter("realised > 0 and f > 0").groupBy(by, "period", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("qlike"), F.avg(own).alias("base"))
    return g.filter(F.col("n") >= least).select(by, "period", "model", "n", "qlike", (100 * (F.col("qlike") / F.col("base") - 1)).alias("change"))
