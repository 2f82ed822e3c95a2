"""Daily aggregates of articles: normalised titles, syndication, attention and weighted sentiment."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import asof_backward


def title_norm(title: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""), " +", " "))


def syndicated(articles: DataFrame) -> DataFrame:
    """The first article of each normalised title (by day, then id), with the number of distinct sources.

    One shuffle by title; sources are counted by aggregation, so a hot title is combined before it.
    """
    keyed = articles.withColumn("title_norm", title_norm(F.col("title")))
    sources = keyed.groupBy("title_norm").agg(F.countDistinct("src").alias("n_syndicated"), F.min(F.struct("d", "doc_id")).alias("first"))
    first = sources.select("title_norm", "n_syndicated", F.col("first.doc_id").alias("doc_id"))
    return keyed.join(first, ["title_norm", "doc_id"])


def _once(articles: DataFrame) -> DataFrame:
    """The first of syndicated articles; rows that carry n_syndicated already are that."""
    return articles if "n_syndicated" in articles.columns else syndicated(articles)


def attention(articles: DataFrame, cal: DataFrame) -> DataFrame:
    """Counts by trading day on the full calendar, with log1p and a no-news flag.

    n_focus counts roundups (is_focus); results_day is 1 if an article on results has the target as its primary name.
    """
    placed = asof_backward(_once(articles), cal)
    primary = F.col("relevance") == 1.0
    by = placed.groupBy(F.col("row_d").alias("d")).agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if(primary).alias("n_primary"), F.countDistinct("src").alias("n_sources"), F.count_if("is_focus").alias("n_focus"),
        F.max((primary & (F.col("kind") == "results")).cast("double")).alias("results_day"), F.max("n_syndicated").alias("syndication"),
    )
    full = cal.select("d").join(by, "d", "left").fillna(0, ["n_articles", "n_primary", "n_sources", "n_focus", "results_day", "syndication"])
    return full.withColumn("log_n", F.log1p(F.col("n_articles").cast("double"))).withColumn("no_news", (F.col("n_articles") == 0).cast("double"))


def weighted_sentiment(articles: DataFrame, cal: DataFrame) -> DataFrame:
    """Relevance-weighted mean and magnitude, and minimum, by trading day, without roundups. A null score keeps its weight in the denominator."""
    placed = asof_backward(articles.filter("relevance > 0 and not is_focus"), cal)
    w, s = F.col("relevance"), F.col("s")
    return placed.groupBy(F.col("row_d").alias("d")).agg(F.try_divide(F.sum(s * w), F.sum(w)).alias("sent"), F.try_divide(F.sum(F.abs(s) * w), F.sum(w)).alias("mag"), F.min(s).alias("sent_min"))


def company_day(news: DataFrame) -> DataFrame:
    """The block of attention, sentiment and signal aggregates by (company, day).

    Takes company, day, role, article_type, source_id, relevance, dup_count, fb_t_net, sent_adj,
    fb_f_net, move_signal, reco_signal, analyst_signal.
    """
    rel, focal = F.col("relevance") > 0, F.col("role").isin("primary", "co_mention", "sector")
    w = F.when(rel, F.col("relevance"))
    weighted = lambda c: F.try_divide(F.sum(F.when(rel, F.col("relevance") * F.col(c))), F.sum(w))
    signed = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    true = F.lit(True)
    return news.groupBy("company", "day").agg(
        F.count(F.lit(1)).alias("n_articles"), F.sum("dup_count").alias("n_syndicated"), F.count_if(F.col("role") == "primary").alias("n_primary"), F.countDistinct("source_id").alias("n_sources"),
        F.count_if(F.col("article_type").isin("results", "results_preview", "results_date")).alias("n_results_news"),
        F.count_if(F.col("article_type").isin("market_wrap", "live_updates", "stocks_to_watch")).alias("n_market_wrap"),
        weighted("fb_t_net").alias("sent_target_w"), weighted("sent_adj").alias("sent_adj_w"),
        F.min(F.when(rel & focal, F.col("fb_t_net"))).alias("sent_target_min"), F.min(F.when(rel & focal, F.col("sent_adj"))).alias("sent_adj_min"),
        F.avg(F.when(F.col("role") == "primary", F.col("sent_adj"))).alias("sent_primary"),
        signed("move_signal", rel).alias("move_net"), F.count_if(rel & (F.col("move_signal") < 0)).alias("n_move_neg"), F.count_if(rel & (F.col("move_signal") > 0)).alias("n_move_pos"),
        signed("reco_signal", true).alias("reco_net"), F.count_if(F.col("reco_signal") > 0).alias("n_buy"), F.count_if(F.col("reco_signal") < 0).alias("n_sell"),
        signed("analyst_signal", true).alias("analyst_net"), F.avg("fb_f_net").alias("sent_full_mean"),
    )


def dup_count(rows: DataFrame, by: list[str]) -> DataFrame:
    """Copies of each key, on every row; a null is a key like any other. Counted by aggregation and joined, so a hot key is combined first."""
    counts = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count(F.lit(1)).alias("dup_count"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return rows.join(counts, same).drop(*[f"_by_{c}" for c in by])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert, keep last: one row of each key, the greatest by `order`."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep first: one row of each key, the least by `order`."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")


def top_of_day(rows: DataFrame, priorities: dict[str, int], by: list[str], time: str = "id") -> DataFrame:
    """The row of highest priority of each key, the first by `time` (then id) among equals, with the group's size and largest value. A null time comes last."""
    m = F.create_map(*[x for k, v in priorities.items() for x in (F.lit(k), F.lit(v))])
    p = rows.filter(F.col(by[0]).isNotNull()).withColumn("priority", F.coalesce(m[F.col("group")], F.lit(len(priorities))))
    return p.groupBy(*by).agg(F.min_by("id", F.struct("priority", F.col(time).isNull(), time, "id")).alias("id"), F.min("priority").cast("long").alias("priority"), F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("largest"))


def carried(daily: DataFrame, by: str, value: str, weight: str, window: int = 30, half_life: float = 5.0) -> DataFrame:
    """Exponential carry over calendar days: sum 2**(-k/half_life) w s over sum 2**(-k/half_life) w, lags 0 to window - 1.

    A day without a score adds its weight alone. Days from the first to the last of `by`; none where no row is in reach,
    null where all weights in reach are zero. Each day is expanded to the days it reaches, then combined: linear in the number of days.
    """
    last = daily.groupBy(F.col(by).alias("_by")).agg(F.max("d").alias("_last"))
    reach = daily.withColumn("_lag", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("_day", F.date_add("d", F.col("_lag")))
    fade = F.pow(F.lit(2.0), -F.col("_lag") / F.lit(half_life)) * F.col(weight)
    carry = reach.groupBy(by, F.col("_day").alias("d")).agg(F.try_divide(F.sum(F.coalesce(fade * F.col(value), F.lit(0.0))), F.sum(fade)).alias("carry"))
    return carry.join(last, F.col(by).eqNullSafe(F.col("_by")) & (F.col("d") <= F.col("_last"))).drop("_by", "_last")


def scored_days(articles: DataFrame, by: str) -> DataFrame:
    """(by, d, s, w) of the days with articles that are no roundups: relevance-weighted sentiment and the weight. A null score counts as zero."""
    own = articles.filter("not is_focus")
    w = F.sum("relevance")
    return own.groupBy(by, "d").agg(F.try_divide(F.sum(F.coalesce(F.col("s") * F.col("relevance"), F.lit(0.0))), w).alias("s"), w.alias("w"))


def daily_table(articles: DataFrame, cal: DataFrame) -> DataFrame:
    """Everything a trading day knows of its articles: attention, sentiment without roundups, the roundups' own paragraphs, and the carry.

    Takes doc_id, d, title, src, s, s_focus, relevance, is_focus, kind. Syndicated copies count once. Missing sentiment is zero.
    """
    kept = _once(articles)
    one = F.lit(1).alias("_one")
    carry = carried(scored_days(kept.select("*", one), "_one"), "_one", "s", "w").select("d", "carry")
    focus = asof_backward(kept, cal).groupBy(F.col("row_d").alias("d")).agg(F.avg("s_focus").alias("focus_para_sent"))
    out = attention(kept, cal).join(weighted_sentiment(kept, cal), "d", "left").join(focus, "d", "left").join(carry, "d", "left")
    return out.fillna(0.0, ["sent", "mag", "sent_min", "focus_para_sent", "carry"]).withColumn("focus_x_carry", F.col("n_focus") * F.col("carry"))
