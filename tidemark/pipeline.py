"""The whole study of one company as one object: articles, scores, daily table, calls, forecasts and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import entity, scoring
from tidemark.functions import signals as g
from tidemark.operators import align, bars, calls, daily, evaluate, state, study, walk
from tidemark.sources import readers
from tidemark.sources.shared import released, written

HAR = ["lrv_d", "lrv_w", "lrv_m"]
ATTENTION = ["log_n", "n_primary", "n_sources", "n_focus", "results_day", "syndication", "no_news"]
SENTIMENT = ["sent", "mag", "sent_min", "focus_para_sent", "carry", "focus_x_carry"]
#: Feature sets of the model rungs, each with all that the one before knows.
RUNGS = {"har": HAR, "attention": HAR + ATTENTION, "sentiment": HAR + ATTENTION + SENTIMENT}


def articles(corpus: DataFrame, target: str, must: str | None = None, exclude: str | None = None) -> DataFrame:
    """Relevant articles on a company: doc_id, d, title, src, role, relevance, kind, is_focus, focus_text, focus_how, signals, n_syndicated.

    Takes doc_id, src, d, title, news. Titles without letters never match; undated rows go. Of syndicated titles the first stays, with the number of its sources.
    """
    rows = corpus.filter("d is not null and title is not null").withColumns({"title": g.plain_html(F.col("title")), "news": g.plain_html(F.coalesce("news", F.lit("")))})
    if must:
        rows = readers.about(rows, must)
    if exclude:
        rows = rows.filter(~g.says(F.col("title"), exclude))
    kept = daily.syndicated(rows).drop("title_norm").withColumn("description", F.substring("news", 1, 400))
    told = entity.analysed(kept, target).select("*", "entity.*").drop("entity").filter("relevance > 0").withColumn("is_focus", g.is_roundup(F.col("title")))
    found = entity.focus(told, target)
    own = {c: F.when(F.col("is_focus"), F.col(c)).otherwise("") for c in ("focus_text", "focus_how")}
    return found.withColumns(own).withColumnRenamed("article_type", "kind").drop("description")


class Pipeline:
    """Takes price bars (symbol, d, o, h, l, c, v), a corpus, and filings (symbol, d, id, sub, headline, path) where there are calls."""

    def __init__(self, prices: DataFrame, corpus: DataFrame, target: str, build: Callable[[], scoring.Scorer], filings: DataFrame | None = None, temperature: float = 1.0):
        self.prices, self.corpus, self.target, self.build, self.filings, self.temperature = prices, corpus, target, build, filings, temperature
        self._tables: dict[str, DataFrame] = {}

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps read, written on its first use."""
        if name not in self._tables:
            self._tables[name] = written(build(), name)
        return self._tables[name]

    def close(self) -> None:
        """Deletes the written tables; what was built from them can no longer be read."""
        released(*self._tables.values())
        self._tables = {}

    def variance(self) -> DataFrame:
        return bars.har(bars.realised(bars.usable(self.prices.filter(F.col("symbol") == self.target))))

    def calendar(self) -> DataFrame:
        return align.numbered(self.variance().select("d"))

    def score_news(self) -> DataFrame:
        """Articles with `s` (of the title) and `s_focus` (of the roundup's paragraph, if it has over 40 characters). The model sees each text once."""
        return self._once("scored", self._scored)

    def _scored(self) -> DataFrame:
        rows = articles(self.corpus, self.target).withColumn("focus_long", F.when(F.length("focus_text") > 40, F.col("focus_text")))
        titles = scoring.scored(rows, "title", self.build, "t", self.target, self.temperature)
        both = scoring.scored(titles, "focus_long", self.build, "f", self.target, self.temperature)
        return both.withColumns({"s": F.col("sent_t"), "s_focus": F.col("sent_f")})

    def daily(self) -> DataFrame:
        return daily.daily_table(self.score_news(), self.calendar())

    def transcripts(self) -> DataFrame | None:
        return None if self.filings is None else study.transcript_filings(self.filings).filter(F.col("symbol") == self.target)

    def flags(self, days: int = 10) -> DataFrame | None:
        """Days with a live call: `days` trading days from each transcript filing on."""
        t = self.transcripts()
        return None if t is None else align.fan_out(t.select("symbol", "d", "id"), self.calendar(), "symbol", days, ["d", "id"]).select("d", F.lit(1.0).alias("call_live"))

    @staticmethod
    def call_sentences(texts: DataFrame) -> DataFrame:
        """Sentences of transcripts (path, text) with context and flags."""
        return calls.sentences(calls.parsed(texts))

    def score_calls(self, texts: DataFrame, model: str, done: DataFrame | None = None, least: int = 50, apart: int = 20) -> DataFrame:
        """A row of features for each call of the target: path, d, symbol, call_time, model and what `calls.features` says.

        Takes transcripts (path, text). Those with fewer than `least` sentences are no calls, and one within `apart` days after a kept one is the same
        call again. With `done` (earlier results of this kind) only paths that this model has not scored are, and calls near those it has are left out.
        """
        filed = self.transcripts().select("symbol", "d", "path").dropna()
        known = None
        if done is not None:
            own = done.filter(F.col("model") == model)
            filed, known = state.pending(filed, done, "path", model), own.select("symbol", "d")
        parsed = calls.parsed(texts.join(filed.select("path").distinct(), "path", "left_semi"))
        sentences = written(calls.sentences(parsed), "sentences")
        real = filed.join(calls.real_calls(sentences, least), "path", "left_semi")
        kept = state.keep_apart(real, "symbol", apart, known)
        scored = scoring.scored(sentences.join(kept.select("path"), "path", "left_semi"), "sentence", self.build, "t", self.target, self.temperature)
        told = calls.features(scored.withColumn("s", F.col("sent_t")))
        return kept.join(told, "path").join(calls.times(texts), "path", "left").withColumn("model", F.lit(model))

    def call_window_panel(self, scored: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
        """Calls with the mean of u = ln(rv_target / rv) over the first h trading days from their own on."""
        u = self.features().select("symbol", "d", "u")
        return calls.window_panel(scored, u, self.calendar(), "symbol", "u", horizons)

    def features(self) -> DataFrame:
        """One row for each trading day: variance lags, everything known of the news, the live-call flag, u = ln(rv_target / base), base: yesterday's variance."""
        return self._once("features", self._features)

    def _features(self) -> DataFrame:
        out = self.variance().join(self.daily(), "d", "left")
        flags = self.flags()
        if flags is not None:
            out = out.join(flags, "d", "left").fillna(0.0, ["call_live"])
        return out.withColumns({"base": F.col("rv"), "u": F.ln(F.col("rv_target") / F.col("rv"))}).filter("rv > 0")

    def rungs(self, table: DataFrame) -> dict[str, list[str]]:
        """The feature sets that the table can serve; the last adds the live call."""
        own = {k: f for k, f in RUNGS.items() if set(f) <= set(table.columns)}
        return own | ({"call": [*next(reversed(own.values())), "call_live"]} if "call_live" in table.columns else {})

    def forecasts(self, table: DataFrame, first: int = 120, size: int = 21) -> DataFrame:
        """(model, symbol, d, u_hat, forecast) of all rungs."""
        parts = [walk.ols(table, "symbol", "u", f, "base", first, size).withColumn("model", F.lit(k)) for k, f in self.rungs(table).items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def evaluate(self, table: DataFrame, forecasts: DataFrame) -> DataFrame:
        """Errors of each rung on the days whose next variance is known."""
        known = forecasts.join(table.select("symbol", "d", "rv_target"), ["symbol", "d"]).filter("rv_target > 0")
        return evaluate.mincer_zarnowitz(known, "rv_target", "forecast", "model")

    def predict_latest(self, table: DataFrame) -> DataFrame:
        """The forecast for the day after the last, by every rung."""
        parts = [walk.latest(table, "symbol", "u", f, "base").withColumn("model", F.lit(k)) for k, f in self.rungs(table).items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
