"""Queries on attention, alignment and bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import align, bars, daily
from tidemark.sources import readers
from tidemark.sources import views as v

from .tidy import sql, tidy

NORM = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
SYND = f"""keyed as (select *, {NORM} as title_norm from articles),
synd as (select title_norm, count(distinct src) as n_syndicated, arg_min(doc_id, row(d, doc_id)) as doc_id from keyed group by title_norm),
kept as (select k.*, n_syndicated from keyed k join synd using (title_norm, doc_id))"""
RV = """steps as (select *, lag(c) over w as lc from bars window w as (partition by symbol order by d)),
rv0 as (select symbol, d, o, h, l, c, v, 100 * ln(c / lc) as ret, ln(o / lc) as overnight, power(ln(h / l), 2) / (4 * ln(2)) as park_var,
  1e4 * (power(ln(o / lc), 2) + power(ln(h / l), 2) / (4 * ln(2))) as rv from steps where lc is not null),
rv as (select *, lead(rv) over (partition by symbol order by d) as rv_target from rv0)"""


def world(spark, sf):
    b = v.bars(spark, sf)
    return b, v.calendar(b)


def attention_daily(spark, sf):
    return tidy(daily.attention(v.articles(spark, sf), world(spark, sf)[1]))


def weighted_sentiment_daily(spark, sf):
    return tidy(daily.weighted_sentiment(v.articles(spark, sf), world(spark, sf)[1]))


def dedupe_syndication(spark, sf):
    return tidy(daily.syndicated(v.articles(spark, sf)).select("doc_id", "title_norm", "n_syndicated"))


def _news(spark, sf):
    i = F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.floor(i / k) % len(names) + 1).cast("int"))
    a = v.articles(spark, sf).select(
        F.col("doc_id"), F.substring("title", 1, 1).alias("company"), F.col("d").alias("day"), pick(("primary", "co_mention", "list_member", "peripheral"), 1).alias("role"), pick(("results", "market_wrap", "other", "results_date"), 2).alias("article_type"),
        F.col("src").alias("source_id"), "relevance", F.col("s").alias("fb_t_net"), (i % 3 - 1).alias("move_signal"), (F.floor(i / 3) % 3 - 1).alias("reco_signal"), (F.floor(i / 9) % 3 - 1).alias("analyst_signal"), (F.coalesce("s", F.lit(0.0)) / 2).alias("fb_f_net"), "title",
    )
    return a.withColumn("sent_adj", F.when(F.col("move_signal") != 0, F.col("move_signal").cast("double")).otherwise(F.col("fb_t_net")))


NEWS = """news0 as (select doc_id, substr(title, 1, 1) as company, d as day, ['primary', 'co_mention', 'list_member', 'peripheral'][doc_id % 4 + 1] as role, ['results', 'market_wrap', 'other', 'results_date'][doc_id // 2 % 4 + 1] as article_type,
  src as source_id, relevance, s as fb_t_net, doc_id % 3 - 1 as move_signal, doc_id // 3 % 3 - 1 as reco_signal, doc_id // 9 % 3 - 1 as analyst_signal, coalesce(s, 0.0) / 2 as fb_f_net, title from articles),
news1 as (select *, case when move_signal <> 0 then cast(move_signal as double) else fb_t_net end as sent_adj from news0),
news as (select *, count(*) over (partition by company, title) as dup_count from news1)"""


def company_day_block(spark, sf):
    return tidy(daily.company_day(daily.dup_count(_news(spark, sf), ["company", "title"])))


def dup_count(spark, sf):
    return tidy(daily.dup_count(v.articles(spark, sf).select("doc_id", "src", "title"), ["title"]).select("doc_id", "dup_count"))


def union_scan(spark, sf):
    forms = {"documents": ("doc_id", "text"), "pages": ("page_id", "url"), "benchmark": ("item_id", "text"), "conversations": ("conv_id", "text")}
    out = readers.united({t: v.read(spark, sf, t).select(F.col(i).cast("string").alias("id"), F.col(x).alias("date")) for t, (i, x) in forms.items()})
    return tidy(out.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("dated"), F.countDistinct("id").alias("ids")))


def price_crosscheck(spark, sf):
    b = world(spark, sf)[0]
    a, n = (b.filter(F.col("symbol") == s).select("d", F.col("c").alias(f"c_{s}")) for s in "AN")
    j = a.join(n, "d").withColumn("ratio", F.col("c_A") / F.col("c_N"))
    return tidy(j.agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("med"), F.stddev_samp("ratio").alias("sd"), F.min("d").alias("first_d"), F.max("d").alias("last_d")))


def missing_days(spark, sf):
    b = world(spark, sf)[0]
    days = lambda s: b.filter(F.col("symbol") == s).select("d")
    a = days("A").join(days("N"), "d", "left_anti").withColumn("side", F.lit("A"))
    return tidy(a.unionByName(days("N").subtract(days("A")).withColumn("side", F.lit("N"))))


def semi_flags(spark, sf):
    b, cal = world(spark, sf)
    f = v.filings(spark, sf).filter(F.col("sub") == "P").select("d").distinct().withColumn("flag", F.lit(1.0))
    return tidy(cal.join(f, "d", "left").select("d", F.coalesce("flag", F.lit(0.0)).alias("results_day")))


def calendar_left_fill(spark, sf):
    b, cal = world(spark, sf)
    sides = [b.filter(F.col("symbol") == s).select("d", F.col("c").alias(f"c_{s}")) for s in "ANR"]
    return tidy(sides[0].join(sides[1], "d", "full_outer").join(sides[2], "d", "full_outer").select("d", *[F.coalesce(f"c_{s}", F.lit(0.0)).alias(f"c_{s}".lower()) for s in "ANR"]))


def dedupe_composite(spark, sf):
    f = v.filings(spark, sf).withColumn("path", F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), (F.col("id") % 97).cast("string"))))
    f = f.withColumn("key", F.coalesce("path", F.concat_ws("|", F.col("d").cast("string"), "sub", "group")))
    return tidy(daily.first_of(f.select("symbol", "key", "d", "id"), ["symbol", "key"], ["d", "id"]))


def upsert_latest(spark, sf):
    return tidy(daily.latest(v.read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"))


def topk_moves(spark, sf):
    r = bars.realised(bars.usable(world(spark, sf)[0]))
    return tidy(r.orderBy(F.desc(F.abs("ret")), "symbol", "d").limit(8).select("symbol", "d", "ret"))


def results_priority(spark, sf):
    f = v.filings(spark, sf)
    return tidy(daily.top_of_day(f, {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, ["symbol", "d"]))


def asof_backward(spark, sf):
    return tidy(align.asof_backward(v.articles(spark, sf).select("doc_id", "d"), world(spark, sf)[1]).select("doc_id", "row_d", "row_seq"))


def reaction_day(spark, sf):
    return tidy(align.reaction_day(v.filings(spark, sf).select("id", "d", "after_close"), world(spark, sf)[1]).select("id", "react_d"))


def shifted_target(spark, sf):
    return tidy(align.shifted(bars.realised(world(spark, sf)[0]), "d", "rv", ["symbol"]))


def _meetings(spark, sf):
    f = v.filings(spark, sf).select("symbol", "d", "sub", "id")
    return f.filter(F.col("sub") == "O"), f.filter(F.col("sub") == "P")


MEET = """meet as (select symbol, d, id from filings where sub = 'O'), res as (select distinct symbol, d from filings where sub = 'P'),
iv as (select m.symbol, m.d as s, coalesce(min(r.d), cast(m.d + 15 as date)) as e from (select distinct symbol, d from meet) m left join res r on r.symbol = m.symbol and r.d between m.d and m.d + 15 group by m.symbol, m.d)"""


def announcement_flags(spark, sf):
    meet, res = _meetings(spark, sf)
    return tidy(align.interval_flags(align.active_intervals(meet, res, "symbol"), world(spark, sf)[1], "symbol"))


def meet_before_results(spark, sf):
    meet, res = _meetings(spark, sf)
    return tidy(align.followed_within(meet.select("symbol", "d", "id"), res, "symbol").select("symbol", "d", "id"))


def call_live_fanout(spark, sf):
    calls = v.filings(spark, sf).select("symbol", "d", "id")
    return tidy(align.fan_out(calls, world(spark, sf)[1], "symbol", 10, ["d", "id"]).select("symbol", "d", "id", "days_since"))


def event_cluster(spark, sf):
    return tidy(align.cluster_starts(v.filings(spark, sf).filter(F.col("sub") == "P").select("symbol", "d").distinct(), "symbol"))


def event_path(spark, sf):
    b, cal = world(spark, sf)
    r = bars.realised(b).join(cal, "d").withColumn("x", F.ln("rv"))
    events = v.articles(spark, sf).select("d").distinct().join(cal, "d")
    return tidy(align.event_path(events, r, "x"))


def close_shift(spark, sf):
    return tidy(v.read(spark, sf, "events").groupBy(align.close_shift(F.col("ts").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def next_business_day(spark, sf):
    return tidy(world(spark, sf)[1].select("d", align.business_day_add(F.col("d")).alias("nbd")))


def event_window_mean(spark, sf):
    r = bars.realised(world(spark, sf)[0]).withColumn("x", F.ln("rv"))
    for h in (1, 5, 10):
        r = align.window_mean(r, "symbol", "x", h, f"u_{h}d")
    return tidy(r.select("symbol", "d", "u_1d", "u_5d", "u_10d"))


def bars_ohlc(spark, sf):
    return tidy(bars.usable(world(spark, sf)[0]).select("symbol", "d", "o", "h", "l", "c", "v"))


def adjusted_bars(spark, sf):
    return tidy(bars.adjusted(world(spark, sf)[0], F.when(F.dayofmonth("d") % 7 != 0, 1 - F.dayofmonth("d") / 997.0)).select("symbol", "d", "o", "h", "l", "c"))


def realised_var(spark, sf):
    return tidy(bars.realised(world(spark, sf)[0]).select("symbol", "d", "ret", "overnight", "park_var", "rv", "rv_target"))


def har_features(spark, sf):
    return tidy(bars.har(bars.realised(world(spark, sf)[0])).select("symbol", "d", "lrv_d", "lrv_w", "lrv_m", "dow"))


def rv_forward21(spark, sf):
    return tidy(bars.forward_mean(bars.realised(world(spark, sf)[0])).select("symbol", "d", "rv_fwd"))


def ffill_market(spark, sf):
    b = world(spark, sf)[0]
    m = bars.realised(b).filter((F.col("symbol") == "N") & (F.dayofmonth("d") % 3 != 0)).select("d", F.col("rv").alias("mkt"))
    return tidy(bars.filled(bars.realised(b).filter(F.col("symbol") == "A").select("symbol", "d", "rv").join(m, "d", "left"), "mkt").select("d", "rv", "mkt"))


def _scored_days(spark, sf):
    return daily.scored_days(v.articles(spark, sf).withColumn("lang", F.substring("src", 4, 1)), "lang")


def carry_decay(spark, sf):
    return tidy(daily.carried(_scored_days(spark, sf), "lang", "s", "w"))


def focus_x_carry(spark, sf):
    a = v.articles(spark, sf).withColumn("lang", F.substring("src", 4, 1))
    focus = a.groupBy("lang", "d").agg(F.count(F.lit(1)).cast("double").alias("focus"))
    return tidy(focus.join(daily.carried(_scored_days(spark, sf), "lang", "s", "w"), ["lang", "d"], "left").select("lang", "d", (F.col("focus") * F.coalesce("carry", F.lit(0.0))).alias("focus_x_carry")))


def daily_table(spark, sf):
    return tidy(daily.daily_table(v.articles(spark, sf), world(spark, sf)[1]))


def dup_count_nulls(spark, sf):
    """Null keys are keys: every third article has no title."""
    a = v.articles(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("title")).alias("title"), F.col("src").alias("company"))
    return tidy(daily.dup_count(a, ["company", "title"]).select("doc_id", "dup_count"))


def cum_gain(spark, sf):
    r = bars.realised(world(spark, sf)[0]).withColumn("diff", F.ln("rv") - F.lag(F.ln("rv")).over(Window.partitionBy("symbol").orderBy("d")))
    return tidy(bars.cumulative(r, "diff", "gain").select("symbol", "d", "gain"))


def lnrv_panel(spark, sf):
    return tidy(bars.panel(bars.realised(world(spark, sf)[0]), ["A", "N", "R"]).toDF("d", "a", "n", "r"))


QUERIES = {f.__name__: f for f in (attention_daily, weighted_sentiment_daily, dedupe_syndication, company_day_block, dup_count, union_scan, price_crosscheck, missing_days, semi_flags, calendar_left_fill, dedupe_composite, upsert_latest, topk_moves, results_priority, asof_backward, reaction_day, shifted_target, announcement_flags, meet_before_results, call_live_fanout, event_cluster, event_path, close_shift, next_business_day, event_window_mean, bars_ohlc, adjusted_bars, realised_var, har_features, rv_forward21, ffill_market, carry_decay, focus_x_carry, daily_table, dup_count_nulls, cum_gain, lnrv_panel)}

ASOF = "asof join cal c on x.d >= c.d"
DAYS = """days as (select lang, d, sum(coalesce(s * relevance, 0)) / nullif(sum(relevance), 0) as s, sum(relevance) as w from (select *, substr(src, 4, 1) as lang from articles) where not is_focus group by lang, d),
carried as (select lang, day as d, sum(coalesce(f * s, 0)) / nullif(sum(f), 0) as carry
  from (select lang, cast(d + k as date) as day, s, power(2.0, -k / 5.0) * w as f, max(d) over (partition by lang) as last_d from days, (select unnest(range(0, 30)) :: integer as k)) where day <= last_d group by lang, day)"""
PLACED = f"""placed as (select c.d, src, relevance, n_syndicated, is_focus, kind, s_focus from kept x {ASOF}),
      agg as (select d, count(*) as a, count(*) filter (relevance = 1.0) as b, count(distinct src) as e, max(n_syndicated) as f, count(*) filter (is_focus) as g, max((relevance = 1.0 and kind = 'results') :: double) as h, avg(s_focus) as p from placed group by d)"""
ORACLE = {
    "daily_table": sql("bars cal articles", "d:d n_articles:i n_primary:i n_sources:i n_focus:i results_day:f syndication:i log_n:f no_news:f sent:f mag:f sent_min:f focus_para_sent:f carry:f focus_x_carry:f", f"""{SYND}, {PLACED},
      own as (select c.d, sum(s * relevance) / sum(relevance) as sent, sum(abs(s) * relevance) / sum(relevance) as mag, min(s) as sent_min from (select * from kept where relevance > 0 and not is_focus) x {ASOF} group by c.d),
      days as (select d, sum(coalesce(s * relevance, 0)) / nullif(sum(relevance), 0) as s, sum(relevance) as w from kept where not is_focus group by d),
      carried as (select day as d, sum(coalesce(f * s, 0)) / nullif(sum(f), 0) as carry from (select cast(d + k as date) as day, s, power(2.0, -k / 5.0) * w as f from days, (select unnest(range(0, 30)) :: integer as k)) where day <= (select max(d) from days) group by day) ;;
      select cal.d, coalesce(a, 0) as n_articles, coalesce(b, 0) as n_primary, coalesce(e, 0) as n_sources, coalesce(g, 0) as n_focus, coalesce(h, 0) as results_day, coalesce(f, 0) as syndication, ln(1 + coalesce(a, 0)) as log_n, case when a is null then 1.0 else 0.0 end as no_news,
      coalesce(sent, 0) as sent, coalesce(mag, 0) as mag, coalesce(sent_min, 0) as sent_min, coalesce(p, 0) as focus_para_sent, coalesce(carry, 0) as carry, coalesce(g, 0) * coalesce(carry, 0) as focus_x_carry
      from cal left join agg using (d) left join own using (d) left join carried using (d)"""),
    "dup_count_nulls": sql("articles", "doc_id dup_count:i", "select doc_id, count(*) over (partition by src, case when doc_id % 3 <> 0 then title end) as dup_count from articles"),
    "attention_daily": sql("bars cal articles", "d:d n_articles:i n_primary:i n_sources:i n_focus:i results_day:f syndication:i log_n:f no_news:f", f"""{SYND}, {PLACED} ;;
      select cal.d, coalesce(a, 0) as n_articles, coalesce(b, 0) as n_primary, coalesce(e, 0) as n_sources, coalesce(g, 0) as n_focus, coalesce(h, 0) as results_day, coalesce(f, 0) as syndication, ln(1 + coalesce(a, 0)) as log_n, case when a is null then 1.0 else 0.0 end as no_news from cal left join agg using (d)"""),
    "weighted_sentiment_daily": sql("bars cal articles", "d:d sent:f mag:f sent_min:f", f"select c.d, sum(s * relevance) / sum(relevance) as sent, sum(abs(s) * relevance) / sum(relevance) as mag, min(s) as sent_min from (select * from articles where relevance > 0 and not is_focus) x {ASOF} group by c.d"),
    "dedupe_syndication": sql("articles", "doc_id title_norm n_syndicated:i", f"{SYND} ;; select * from kept"),
    "company_day_block": sql("articles", "company day:d n_articles:i n_syndicated:i n_primary:i n_sources:i n_results_news:i n_market_wrap:i sent_target_w:f sent_adj_w:f sent_target_min:f sent_adj_min:f sent_primary:f move_net:i n_move_neg:i n_move_pos:i reco_net:i n_buy:i n_sell:i analyst_net:i sent_full_mean:f", f"""{NEWS} ;;
      select company, day, count(*) as n_articles, sum(dup_count) as n_syndicated, count(*) filter (role = 'primary') as n_primary, count(distinct source_id) as n_sources,
      count(*) filter (article_type in ('results', 'results_preview', 'results_date')) as n_results_news, count(*) filter (article_type in ('market_wrap', 'live_updates', 'stocks_to_watch')) as n_market_wrap,
      sum(relevance * fb_t_net) filter (relevance > 0) / sum(relevance) filter (relevance > 0) as sent_target_w, sum(relevance * sent_adj) filter (relevance > 0) / sum(relevance) filter (relevance > 0) as sent_adj_w,
      min(fb_t_net) filter (relevance > 0 and role in ('primary', 'co_mention', 'sector')) as sent_target_min, min(sent_adj) filter (relevance > 0 and role in ('primary', 'co_mention', 'sector')) as sent_adj_min,
      avg(sent_adj) filter (role = 'primary') as sent_primary, coalesce(sum(move_signal) filter (relevance > 0), 0) as move_net, count(*) filter (relevance > 0 and move_signal < 0) as n_move_neg, count(*) filter (relevance > 0 and move_signal > 0) as n_move_pos,
      sum(reco_signal) as reco_net, count(*) filter (reco_signal > 0) as n_buy, count(*) filter (reco_signal < 0) as n_sell, sum(analyst_signal) as analyst_net, avg(fb_f_net) as sent_full_mean from news group by company, day"""),
    "dup_count": sql("articles", "doc_id dup_count:i", "select doc_id, count(*) over (partition by title) as dup_count from articles"),
    "union_scan": sql("", "src n:i dated:i ids:i", "select src, count(*) as n, count(try_cast(substr(x, 1, 10) as date)) as dated, count(distinct id) as ids from (select 'documents' as src, doc_id as id, text as x from documents union all select 'pages', page_id, url from pages union all select 'benchmark', item_id, text from benchmark union all select 'conversations', conv_id, text from conversations) group by src"),
    "price_crosscheck": sql("bars", "n:i med:f sd:f first_d:d last_d:d", "select count(*) as n, median(a.c / b.c) as med, stddev_samp(a.c / b.c) as sd, min(a.d) as first_d, max(a.d) as last_d from bars a join bars b using (d) where a.symbol = 'A' and b.symbol = 'N'"),
    "missing_days": sql("bars", "d:d side", "(select d, 'A' as side from (select d from bars where symbol = 'A' except select d from bars where symbol = 'N')) union all (select d, 'N' from (select d from bars where symbol = 'N' except select d from bars where symbol = 'A'))"),
    "semi_flags": sql("bars cal filings", "d:d results_day:f", "select d, case when d in (select d from filings where sub = 'P') then 1.0 else 0.0 end as results_day from cal"),
    "calendar_left_fill": sql("bars", "d:d c_a:f c_n:f c_r:f", "select d, coalesce(max(c) filter (symbol = 'A'), 0) as c_a, coalesce(max(c) filter (symbol = 'N'), 0) as c_n, coalesce(max(c) filter (symbol = 'R'), 0) as c_r from bars where symbol in ('A', 'N', 'R') group by d"),
    "dedupe_composite": sql("filings", "symbol key d:d id", """select symbol, key, d, id from (select *, row_number() over (partition by symbol, key order by d, id) as r from (select *, case when id % 4 <> 0 then 'p' || (id % 97) else cast(d as varchar) || '|' || sub || '|' || "group" end as key from filings)) where r = 1"""),
    "upsert_latest": sql("", "user_id event_type event_id value:f", "select * from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1"),
    "topk_moves": sql("bars", "symbol d:d ret:f", f"{RV} ;; select symbol, d, ret from rv order by abs(ret) desc, symbol, d limit 8"),
    "results_priority": sql("filings", "symbol d:d id priority:i n:i largest:f", """select symbol, d, arg_min(id, row(p, id)) as id, min(p) as priority, count(*) as n, max(abs(value)) as largest from (select *, case "group" when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end as p from filings) where symbol is not null group by symbol, d"""),
    "asof_backward": sql("bars cal articles", "doc_id row_d:d row_seq:i", f"select doc_id, c.d as row_d, c.seq as row_seq from articles x {ASOF}"),
    "reaction_day": sql("bars cal filings", "id react_d:d", """nxt as (select f.id, f.d, f.after_close, c.d as nd, c.seq from filings f asof join cal c on f.d <= c.d) ;;
      select id, r.d as react_d from (select id, case when d = nd and after_close then seq + 1 else seq end as s from nxt) n join cal r on r.seq = n.s where n.s > 1"""),
    "shifted_target": sql("bars", "symbol d:d target:f", f"{RV} ;; select symbol, d2 as d, rv as target from (select symbol, lead(d) over (partition by symbol order by d) as d2, rv from rv) where d2 is not null"),
    "announcement_flags": sql("bars cal filings", "symbol d:d", f"{MEET} ;; select distinct symbol, cal.d from iv join cal on cal.d between s and e"),
    "meet_before_results": sql("filings", "symbol d:d id", f"{MEET} ;; select * from meet m where exists (select 1 from res r where r.symbol = m.symbol and r.d between m.d and m.d + 15)"),
    "call_live_fanout": sql("bars cal filings", "symbol d:d id days_since:i", """calls as (select f.symbol, f.d as pd, f.id, c.seq from filings f asof join cal c on f.d >= c.d) ;;
      select symbol, d, id, seq - s0 as days_since from (select c.symbol, c.id, c.seq as s0, cal.seq, cal.d, row_number() over (partition by c.symbol, cal.seq order by c.pd desc, c.id desc) as r from calls c join cal on cal.seq between c.seq and c.seq + 9) where r = 1"""),
    "event_cluster": sql("filings", "symbol d:d", "select symbol, d from (select *, lag(d) over (partition by symbol order by d) as b from (select distinct symbol, d from filings where sub = 'P')) where b is null or d - b > 5"),
    "event_path": sql("bars cal articles", "offset_:i mean:f n:i", f"""{RV}, r as (select seq, ln(rv) as x from rv join cal using (d)), ev as (select seq from cal where d in (select d from articles)) ;;
      select r.seq - ev.seq as offset_, avg(x) as mean, count(x) as n from ev join r on r.seq between ev.seq - 5 and ev.seq + 20 group by 1""").replace("cast(offset_ as bigint) as offset_", 'cast(offset_ as bigint) as "offset"'),
    "close_shift": sql("", "day:d n:i total:f", "select cast(l + case when extract(hour from l) * 60 + extract(minute from l) >= 930 then interval 1 day else interval 0 day end as date) as day, count(*) as n, sum(value) as total from (select ts + interval 330 minute as l, value from events) group by 1"),
    "next_business_day": sql("bars cal", "d:d nbd:d", "select d, cast(d + case isodow(d) when 5 then 3 when 6 then 2 else 1 end as date) as nbd from cal"),
    "event_window_mean": sql("bars", "symbol d:d u_1d:f u_5d:f u_10d:f", RV + ";; select symbol, d, " + ", ".join(f"case when count(ln(rv)) over w{h} = {h} then avg(ln(rv)) over w{h} end as u_{h}d" for h in (1, 5, 10)) + " from rv window " + ", ".join(f"w{h} as (partition by symbol order by d rows between 1 following and {h} following)" for h in (1, 5, 10))),
    "bars_ohlc": sql("bars", "symbol d:d o:f h:f l:f c:f v:f", "select * from bars where v > 0"),
    "adjusted_bars": sql("bars", "symbol d:d o:f h:f l:f c:f", "select symbol, d, o * f as o, h * f as h, l * f as l, c * f as c from (select *, case when day(d) % 7 <> 0 then 1 :: double - day(d) / 997.0 :: double else 1.0 :: double end as f from bars)"),
    "realised_var": sql("bars", "symbol d:d ret:f overnight:f park_var:f rv:f rv_target:f", f"{RV} ;; select * from rv"),
    "har_features": sql("bars", "symbol d:d lrv_d:f lrv_w:f lrv_m:f dow:i", f"""{RV} ;; select symbol, d, ln(rv) as lrv_d, case when count(rv) over a = 5 then ln(avg(rv) over a) end as lrv_w, case when count(rv) over b = 22 then ln(avg(rv) over b) end as lrv_m, isodow(d) - 1 as dow from rv
      window a as (partition by symbol order by d rows 4 preceding), b as (partition by symbol order by d rows 21 preceding)"""),
    "rv_forward21": sql("bars", "symbol d:d rv_fwd:f", f"{RV} ;; select symbol, d, case when count(rv) over a >= 15 then avg(rv) over a end as rv_fwd from rv window a as (partition by symbol order by d rows between 1 following and 21 following)"),
    "ffill_market": sql("bars", "d:d rv:f mkt:f", f"{RV} ;; select a.d, a.rv, last_value(m.rv ignore nulls) over (order by a.d rows unbounded preceding) as mkt from rv a left join (select d, rv from rv where symbol = 'N' and day(d) % 3 <> 0) m using (d) where a.symbol = 'A'"),
    "carry_decay": sql("articles", "lang d:d carry:f", f"{DAYS} ;; select * from carried"),
    "focus_x_carry": sql("articles", "lang d:d focus_x_carry:f", f"{DAYS}, focus as (select substr(src, 4, 1) as lang, d, count(*) as focus from articles group by 1, 2) ;; select lang, d, focus * coalesce(carry, 0) as focus_x_carry from focus left join carried using (lang, d)"),
    "cum_gain": sql("bars", "symbol d:d gain:f", f"{RV} ;; select symbol, d, sum(x) over (partition by symbol order by d rows unbounded preceding) as gain from (select symbol, d, ln(rv) - lag(ln(rv)) over (partition by symbol order by d) as x from rv)"),
    "lnrv_panel": sql("bars", "d:d a:f n:f r:f", f"{RV} ;; select * from (select d, max(ln(rv)) filter (symbol = 'A') as a, max(ln(rv)) filter (symbol = 'N') as n, max(ln(rv)) filter (symbol = 'R') as r from rv where rv > 0 group by d) where a is not null and n is not null and r is not null"),
}
