"""The daily job: refresh prices and headlines, score what is new, publish the tables. Sources and model are passed in."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import align, bars, daily, tracker, walk
from tidemark.operators.align import business_day_add
from tidemark.sources.shared import written

from .live import Merged, recent, unknown, written_reports

Fetch = Callable[[date, date], DataFrame]
PRICES = "symbol string, d date, o double, h double, l double, c double, v double"
HEADLINES = "title string, published timestamp, d date, source string, url string, relevance double"


class DailyJob:
    """State is two tables of base and deltas below one folder; a run writes its own rows, and its reports to `public`.

    `prices(since, until)` and `news(since, until)` give rows of PRICES and HEADLINES; `scorer()` builds
    a model. A run with nothing new changes nothing. Live forecasts start once `least` days have a known target.
    """

    def __init__(self, spark: SparkSession, folder: str, prices: Fetch, news: Fetch, scorer: Callable[[], scoring.Scorer], first: date, overlap: int = 10, back: int = 2, first_back: int = 7, least: int = 30, test_start: str = "2024-01-01"):
        self.spark, self.folder, self.prices, self.news, self.scorer = spark, folder, prices, news, scorer
        self.first, self.overlap, self.back, self.first_back, self.least, self.test_start = first, overlap, back, first_back, least, test_start

    def table(self, name: str) -> Merged:
        return Merged(self.spark, f"{self.folder}/{name}", *(["symbol", "d"], ["_load"]) if name == "prices" else ())

    def _last(self, df: DataFrame | None, column: str) -> date | None:
        return None if df is None else df.agg(F.max(F.to_date(column))).first()[0]

    def update_prices(self, today: date, version: int) -> DataFrame:
        """Asks again for the last days, drops incomplete bars and keeps the newest row of each day."""
        last = self._last(self.table("prices").read(version), "d")
        new = self.prices(last - timedelta(days=self.overlap) if last else self.first, today).dropna(subset=["o", "h", "l", "c"]).withColumn("_load", F.lit(version))
        self.table("prices").add(daily.first_of(new, ["symbol", "d"], ["v", "c"]).select(new.columns), version)
        return self.table("prices").read().drop("_load")

    def update_news(self, today: date, version: int) -> DataFrame:
        """Asks from some days before the last headline on; unseen titles of a day are scored once and added."""
        before = self.table("news").read(version)
        last = self._last(before, "published")
        since = last - timedelta(days=self.back) if last else today - timedelta(days=self.first_back)
        new = self.news(since, today).withColumn("norm", daily.title_norm(F.col("title")))
        new = daily.first_of(new, ["norm", "d"], ["published", "title", "url"])
        new = unknown(new, before, ["norm", "d"])
        asked = new.withColumn("asked", F.when(F.col("relevance") > 0, F.col("title")))
        scored = scoring.scored(asked, "asked", self.scorer, "live").select(*new.columns, F.col("sent_live").alias("s"))
        self.table("news").add(scored, version)
        return self.table("news").read()

    def features(self, prices: DataFrame, news: DataFrame) -> DataFrame:
        """Variance lags, and headlines counted on the last trading day up to theirs; u = ln(rv_target / rv)."""
        rv = bars.har(bars.realised(bars.usable(prices)))
        cal = align.numbered(rv.select("d"))
        counts = align.asof_backward(news.filter("relevance > 0"), cal).groupBy(F.col("row_d").alias("d")).agg(F.log1p(F.count(F.lit(1))).alias("log_n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("sent"))
        return rv.join(counts, "d", "left").fillna(0.0, ["log_n", "sent"]).withColumns({"base": F.col("rv"), "u": F.ln(F.col("rv_target") / F.col("rv"))}).filter("rv > 0")

    def reports(self, prices: DataFrame, news: DataFrame) -> dict[str, DataFrame]:
        """The tracker of the walk-forward forecasts, its summary, the next day's forecasts, coefficients, and the latest headlines."""
        table = written(self.features(prices, news), "live")
        sets = {"har": ["lrv_d", "lrv_w"], "news": ["lrv_d", "lrv_w", "log_n", "sent"]}
        walked = table.select("symbol", "d", "rv", F.col("rv").alias("last"))
        latest, effects = [], []
        for name, features in sets.items():
            one = walk.ols(table, "symbol", "u", features, "base", self.least, 21).select("symbol", "d", F.col("forecast").alias(name))
            walked = walked.join(one, ["symbol", "d"])
            latest.append(walk.latest(table, "symbol", "u", features, "base").withColumn("model", F.lit(name)))
            effects.append(walk.unit_effects(table, "symbol", "u", features).withColumn("model", F.lit(name)))
        models = ["last", *sets]
        tracked = tracker.tracked(walked, "symbol", models, self.test_start)
        next_day = latest[0].unionByName(latest[1]).select("symbol", "model", "d", business_day_add(F.col("d")).alias("forecast_for"), "forecast", F.sqrt("forecast").alias("sigma"))
        return {"tracker": tracked, "summary": tracker.summary(tracked, "symbol", models, "last"), "latest": next_day, "coefficients": effects[0].unionByName(effects[1]), "headlines": recent(news, "published")}

    def run(self, today: date, version: int) -> dict[str, DataFrame]:
        prices, news = self.update_prices(today, version), self.update_news(today, version)
        reports = self.reports(prices, news)
        written_reports(reports, f"{self.folder}/public")
        return {"prices": prices, "news": news, **reports}
