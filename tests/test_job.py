"""The daily job: nothing is lost or doubled on a second day, and one day is pending."""

import datetime as dt
import math

from tidemark.functions.scoring import LexiconScorer
from tidemark.streaming.job import HEADLINES, PRICES, DailyJob

START = dt.date(2024, 1, 1)


def days(n):
    return [d for d in (START + dt.timedelta(days=i) for i in range(n)) if d.weekday() < 5]


def test_second_day(spark, tmp_path):
    price = lambda d: 100 + 5 * math.sin(d.toordinal())

    def prices(since, until):
        return spark.createDataFrame([("T", d, price(d), price(d) * 1.02, price(d) * 0.98, price(d) * 1.01, 10.0) for d in days(80) if since <= d <= until] + [("T", until, None, 1.0, 1.0, 1.0, 1.0)], PRICES)

    def news(since, until):
        return spark.createDataFrame([(f"Up {d}!", dt.datetime(d.year, d.month, d.day, 5), d, "s", "u", float(d.day % 2)) for d in days(80) if since <= d <= until] * 2, HEADLINES)

    job = DailyJob(spark, str(tmp_path), prices, news, lambda: LexiconScorer(["up"], ["down"]), START)
    first = job.run(dt.date(2024, 2, 9), 1)
    n = first["prices"].count()
    second = job.run(dt.date(2024, 3, 8), 2)
    again = job.run(dt.date(2024, 3, 8), 3)
    assert n == 30 and second["prices"].count() == again["prices"].count() == 50
    titles = [r["title"] for r in again["news"].collect()]
    assert len(titles) == len(set(titles)) == second["news"].count()
    assert again["tracker"].filter("pending").count() == 1 and again["tracker"].filter("pending").first()["d"] == dt.date(2024, 3, 11)
    scores = {r["relevance"]: r["s"] for r in again["news"].collect()}
    assert scores[1.0] > 0 and scores[0.0] is None
    assert {r["model"] for r in again["summary"].collect()} == {"last", "har", "news"} and again["headlines"].count() > 0
    latest = {r["model"]: r for r in again["latest"].collect()}
    assert set(latest) == {"har", "news"} and all(r["forecast"] > 0 and r["forecast_for"] == dt.date(2024, 3, 11) for r in latest.values())
    public = {n: spark.read.json(f"{tmp_path}/public/{n}").count() for n in ("tracker", "summary", "latest", "coefficients", "headlines")}
    assert public == {n: again[n].count() for n in public} and public["coefficients"] == 6
    assert spark.read.parquet(f"{tmp_path}/prices/delta-3").count() < 15  # a day's run writes the days that it asked for
    assert spark.read.parquet(f"{tmp_path}/news/delta-3").count() == 0
