"""Queries that run a finished available-now stream, and stateful selections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import state
from tidemark.sources import views as v
from tidemark.sources.shared import shared_dir
from tidemark.streaming import live

from .tidy import sql, tidy


def _folder(spark) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"


def _slices(spark, sf, df, parts: int = 3):
    """A table written in slices, as a stream of files."""
    root = _folder(spark)
    for k in range(parts):
        df.filter(F.pmod(F.xxhash64(df.columns[0]), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, live.file_stream(spark, f"{root}/in", df.schema)


def stream_upsert(spark, sf):
    e = v.read(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    root, s = _slices(spark, sf, e.select("event_id", "user_id", "event_type", "ts", "value"))
    live.upsert(s, f"{root}/out", f"{root}/checkpoint", ["user_id", "event_type"], ["ts", "event_id"], fold=2).awaitTermination()
    return tidy(live.Merged(spark, f"{root}/out", ["user_id", "event_type"], ["ts", "event_id"]).read().select("user_id", "event_type", "event_id", "value"))


def stream_dedupe_watermark(spark, sf):
    e = v.read(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root, s = _slices(spark, sf, e)
    q = live.deduplicated(s, "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return tidy(spark.read.parquet(f"{root}/out"))


def stream_daily_publish(spark, sf):
    a = v.articles(spark, sf).select("doc_id", "d", "title", "text", "src", "relevance").withColumn("s", F.lit(None).cast("double"))
    root, s = _slices(spark, sf, a)
    live.append_new(s, f"{root}/out", f"{root}/checkpoint", ["title"], ["d", "doc_id"], lambda d: d.withColumn("s", v.lexicon_score(F.col("text")))).awaitTermination()
    t = live.Merged(spark, f"{root}/out").read()
    return tidy(t.groupBy("d").agg(F.countDistinct("title").alias("n"), F.avg("s").alias("s")))


def same_event_filter(spark, sf):
    f = v.filings(spark, sf).groupBy("symbol", "d").agg(F.min("id").cast("string").alias("path"))
    return tidy(state.keep_apart(f, "symbol", 20))


def _lexicon():
    return scoring.LexiconScorer(v.POSITIVE, v.NEGATIVE)


def lexicon_scores(spark, sf):
    s = scoring.scored(v.articles(spark, sf).select("doc_id", "text"), "text", _lexicon, "lex", temperature=2.0)
    return tidy(s.select("doc_id", "z_lex_positive", "z_lex_negative", "p_lex_positive", "p_lex_negative", "p_lex_neutral", "sent_lex"))


QUERIES = {f.__name__: f for f in (stream_upsert, stream_dedupe_watermark, stream_daily_publish, same_event_filter, lexicon_scores)}
ORACLE = {
    "stream_upsert": sql("", "user_id event_type event_id value:f", "select * from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"),
    "stream_dedupe_watermark": sql("", "user_id event_type", "select distinct user_id, event_type from events"),
    "stream_daily_publish": None,
    "lexicon_scores": sql("articles", "doc_id z_lex_positive:f z_lex_negative:f p_lex_positive:f p_lex_negative:f p_lex_neutral:f sent_lex:f", f"""w as (select doc_id, [trim(x, '.,;:!?') for x in regexp_split_to_array(lower(text), '\\s+')] as w from articles),
      n as (select doc_id, len([x for x in w if x in {v.POSITIVE}]) :: double as p, len([x for x in w if x in {v.NEGATIVE}]) :: double as n from w), e as (select *, exp((p - m) / 2) as a, exp((n - m) / 2) as b, exp((0.5 - m) / 2) as c from (select *, greatest(p, n, 0.5 :: double) as m from n)) ;;
      select doc_id, p as z_lex_positive, n as z_lex_negative, a / (a + b + c) as p_lex_positive, b / (a + b + c) as p_lex_negative, c / (a + b + c) as p_lex_neutral, (a - b) / (a + b + c) as sent_lex from e"""),
    "same_event_filter": "with recursive " + sql("filings", "symbol d:d path", """f as (select symbol, d, cast(min(id) as varchar) as path, row_number() over (partition by symbol order by d) as t from filings group by symbol, d),
      r as (select symbol, t, d, path, d as last, true as own from f where t = 1 union all select f.symbol, f.t, f.d, f.path, case when f.d - r.last > 20 then f.d else r.last end, f.d - r.last > 20 from r join f on f.symbol = r.symbol and f.t = r.t + 1) ;; select symbol, d, path from r where own""").removeprefix("with "),
}
ORACLE = {k: q for k, q in ORACLE.items() if q}
