"""Queries on scoring, evaluation and placebo operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.operators import evaluate as ev
from tidemark.sources import views as v

from .daily import NEWS, RV, _news
from .tidy import sql, tidy

NAMES = ["positive", "negative", "neutral"]


def _probs(spark, sf, t=1.0) -> DataFrame:
    z = v.logits(spark, sf)
    p = ev.softmax([F.col("zp"), F.col("zn"), F.col("zu")], t)
    return z.withColumns(dict(zip(("pp", "pn", "pu"), p, strict=True)))


PROBS = """probs as (select id, y, exp((zp - m) / TT) / s as pp, exp((zn - m) / TT) / s as pn, exp((zu - m) / TT) / s as pu from (select *, exp((zp - m) / TT) + exp((zn - m) / TT) + exp((zu - m) / TT) as s from (select *, greatest(zp, zn, zu) as m from logits)))"""
ONE = PROBS.replace("TT", "1.0")
CALLED = "called as (select *, case when pp >= pn and pp >= pu then 0 when pn >= pu then 1 else 2 end as p, greatest(pp, pn, pu) as conf from probs)"


def softmax_temp(spark, sf):
    p = _probs(spark, sf, 2.5)
    return tidy(p.select("id", "pp", "pn", "pu", (F.col("pp") - F.col("pn")).alias("s"), (1 - F.col("pu")).alias("polarity"), ev.argmax([F.col("pp"), F.col("pn"), F.col("pu")], NAMES).alias("label")))


def _called(spark, sf):
    p = _probs(spark, sf).withColumn("p", ev.argmax([F.col("pp"), F.col("pn"), F.col("pu")], [0, 1, 2]).cast("long"))
    return p.withColumn("conf", F.greatest("pp", "pn", "pu")).withColumn("hit", (F.col("p") == F.col("y")).cast("double"))


def calibration_bins(spark, sf):
    return tidy(ev.calibration(_called(spark, sf), "conf", "hit"))


def calibration_error(spark, sf):
    return tidy(ev.calibration_error(ev.calibration(_called(spark, sf), "conf", "hit")))


def brier_nll(spark, sf):
    own = F.element_at(F.array("pp", "pn", "pu"), (F.col("y") + 1).cast("int"))
    b = sum((F.pow(F.col(c) - (F.col("y") == k).cast("double"), 2) for k, c in enumerate(("pp", "pn", "pu"))), F.lit(0.0))
    return tidy(_called(spark, sf).agg(F.avg(b).alias("brier"), F.avg(-F.ln(own + 1e-12)).alias("nll"), F.avg("conf").alias("confidence"), F.avg((F.col("conf") > 0.9).cast("double")).alias("saturated")))


def confusion_f1(spark, sf):
    return tidy(ev.class_scores(_called(spark, sf), "y", "p"))


def pair_acc(spark, sf):
    return tidy(_called(spark, sf).groupBy((F.col("id") / 2).cast("long").alias("pair")).agg(F.bool_and(F.col("hit") == 1).alias("right")).agg(F.avg(F.col("right").cast("double")).alias("pair_accuracy"), F.count(F.lit(1)).alias("pairs")))


def kappa(spark, sf):
    return tidy(ev.kappa(_called(spark, sf).select("y", "p"), "y", "p"))


def mcnemar_counts(spark, sf):
    c = _called(spark, sf).withColumn("other", (F.when(F.col("zp") > F.col("zn"), 0).otherwise(1) == F.col("y")).cast("double"))
    return tidy(c.agg(F.count_if((F.col("hit") == 1) & (F.col("other") == 0)).alias("only_first"), F.count_if((F.col("hit") == 0) & (F.col("other") == 1)).alias("only_second")))


def _forecasts(spark, sf) -> DataFrame:
    """Yesterday's variance and its five-day mean as two forecasts."""
    w = bars.order()
    r = bars.realised(v.bars(spark, sf))
    r = r.withColumns({"f1": F.lag("rv").over(w), "m5": bars.full_mean("rv", 5, w)})
    return r.withColumn("f2", F.lag("m5").over(w)).filter("f2 is not null and rv > 0 and f1 > 0")


FC = RV + """, fc0 as (select *, lag(rv) over w as f1, case when count(rv) over w5 = 5 then avg(rv) over w5 end as m5 from rv window w as (partition by symbol order by d), w5 as (partition by symbol order by d rows 4 preceding)),
fc as (select * from (select *, lag(m5) over (partition by symbol order by d) as f2 from fc0) where f2 is not null and rv > 0 and f1 > 0)"""


def qlike_table(spark, sf):
    masks = {"early": F.col("d") < "1998-01-01", "late": F.col("d") >= "1998-01-01", "monday": F.weekday("d") == 0, "all": F.lit(True)}
    q1, q2 = (F.avg(ev.qlike(F.col("rv"), F.col(f))) for f in ("f1", "f2"))
    g = ev.masked(_forecasts(spark, sf), masks).groupBy("symbol", "subset").agg(F.count(F.lit(1)).alias("n"), q1.alias("q1"), q2.alias("q2")).filter("n >= 5")
    return tidy(g.withColumn("change", 100 * (F.col("q2") / F.col("q1") - 1)))


def mz_r2(spark, sf):
    return tidy(ev.mincer_zarnowitz(_forecasts(spark, sf), "rv", "f2", "symbol"))


def dm_test(spark, sf):
    f = _forecasts(spark, sf).withColumn("diff", ev.qlike(F.col("rv"), F.col("f2")) - ev.qlike(F.col("rv"), F.col("f1")))
    return tidy(ev.diebold_mariano(f, "diff", "symbol", 5))


def hit_rate(spark, sf):
    f = _forecasts(spark, sf).withColumn("hit", (F.abs("ret") <= F.sqrt("f2")).cast("double"))
    return tidy(f.groupBy("symbol").agg(F.avg("hit").alias("share"), F.count(F.lit(1)).alias("n")))


def auc_rank(spark, sf):
    f = _forecasts(spark, sf).withColumn("y", (F.abs("ret") > 100).cast("double")).withColumn("p", F.round(1 / (1 + F.exp(-F.ln("f2") / 10)), 2))
    return tidy(ev.auc(f, "p", "y", "symbol"))


def spearman(spark, sf):
    return tidy(ev.spearman(_forecasts(spark, sf).select("symbol", F.round("f2", 0).alias("x"), F.round("rv", 0).alias("y")), "x", "y", "symbol"))


def welch_days(spark, sf):
    days = v.articles(spark, sf).filter("relevance = 1.0").select("d").distinct().withColumn("flag", F.lit(True))
    r = bars.realised(v.bars(spark, sf)).filter("rv > 0").withColumn("x", F.ln("rv")).join(days, "d", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    return tidy(ev.welch(r, "x", "flag", "symbol"))


def placebo_perm(spark, sf):
    a = v.articles(spark, sf).select("doc_id", "src", "s")
    return tidy(ev.permuted(a, ["s"], "src", "doc_id", 7).select("doc_id", "s"))


def quintile_means(spark, sf):
    f = _forecasts(spark, sf).withColumn("q", F.ntile(5).over(Window.partitionBy("symbol").orderBy("f2", "d")))
    return tidy(f.groupBy("symbol", "q").agg(F.avg(F.ln("rv")).alias("mean"), (F.stddev_samp(F.ln("rv")) / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n")))


def subset_masks(spark, sf):
    n = _news(spark, sf)
    masks = {"results": F.col("article_type").startswith("results"), "primary": F.col("role") == "primary", "negative": F.col("fb_t_net") < -0.3, "no_score": F.col("fb_t_net").isNull()}
    return tidy(ev.masked(n, masks).groupBy("subset", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("fb_t_net").alias("mean")).filter("n >= 15"))


def percentiles(spark, sf):
    f = _forecasts(spark, sf)
    return tidy(f.groupBy("symbol").agg(*[F.percentile("rv", F.lit(p)).alias(n) for n, p in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))]))


def histogram(spark, sf):
    return tidy(_called(spark, sf).groupBy(F.width_bucket("conf", F.lit(0.3), F.lit(1.0), F.lit(7)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def cluster_sums(spark, sf):
    return tidy(v.filings(spark, sf).groupBy("d").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")))


def label_precedence(spark, sf):
    z = v.logits(spark, sf).select("id", "y")
    user, again = (z.filter(F.col("id") % m == 0).select("id", F.lit(n).alias(n)) for m, n in ((7, "user"), (3, "recheck")))
    return tidy(z.join(user, "id", "left").join(again, "id", "left").select("id", F.coalesce("user", "recheck", F.lit("draft")).alias("label_source")))


def single_ols(spark, sf):
    """Walk-forward regression on one feature: at each block start, slope and intercept from all rows before it."""
    f = _forecasts(spark, sf).withColumn("t", F.row_number().over(bars.order()) - 1).withColumns({"x": F.ln("f2"), "y": F.ln("rv")})
    blocks = f.select("symbol", (F.floor(F.col("t") / 210) * 210).alias("s")).distinct().filter("s >= 210")
    daily = f.select("symbol", "t", "x", "y")
    # Sums of squares up to each block start, as running totals: no row is repeated for later blocks.
    by = daily.groupBy("symbol", (F.floor(F.col("t") / 210) * 210 + 210).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    w = Window.partitionBy("symbol").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    run = by.select("symbol", "s", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return tidy(run.join(blocks, ["symbol", "s"]).select("symbol", "s", "n", slope.alias("slope")).withColumn("slope", F.round("slope", 4)))


QUERIES = {f.__name__: f for f in (softmax_temp, calibration_bins, calibration_error, brier_nll, confusion_f1, pair_acc, kappa, mcnemar_counts, qlike_table, mz_r2, dm_test, hit_rate, auc_rank, spearman, welch_days, placebo_perm, quintile_means, subset_masks, percentiles, histogram, cluster_sums, label_precedence, single_ols)}
QL = lambda f: f"(rv / {f} - ln(rv / {f}) - 1)"
RANKS = "(rank() over (partition by symbol order by {0}) + (count(*) over (partition by symbol, {0}) - 1) / 2.0)"
ORACLE = {
    "softmax_temp": sql("logits", "id pp:f pn:f pu:f s:f polarity:f label", PROBS.replace("TT", "2.5") + ";; select *, pp - pn as s, 1 - pu as polarity, case when pp >= pn and pp >= pu then 'positive' when pn >= pu then 'negative' else 'neutral' end as label from probs"),
    "calibration_bins": sql("logits", "bin:i n:i confidence:f accuracy:f", f"{ONE}, {CALLED} ;; select least(floor((conf - 1.0 / 3) / ((1 - 1.0 / 3) / 5)), 4) as bin, count(*) as n, avg(conf) as confidence, avg((p = y) :: integer) as accuracy from called group by 1"),
    "calibration_error": sql("logits", "ece:f", f"{ONE}, {CALLED} ;; select sum(n * abs(c - a)) / sum(n) as ece from (select count(*) as n, avg(conf) as c, avg((p = y) :: integer) as a from called group by least(floor((conf - 1.0 / 3) / ((1 - 1.0 / 3) / 5)), 4))"),
    "brier_nll": sql("logits", "brier:f nll:f confidence:f saturated:f", f"{ONE}, {CALLED} ;; select avg(power(pp - (y = 0) :: integer, 2) + power(pn - (y = 1) :: integer, 2) + power(pu - (y = 2) :: integer, 2)) as brier, avg(-ln(case y when 0 then pp when 1 then pn else pu end + 1e-12)) as nll, avg(conf) as confidence, avg((conf > 0.9) :: integer) as saturated from called"),
    "confusion_f1": sql("logits", "label:i precision:f recall:f f1:f", f"{ONE}, {CALLED} ;; select k as label, coalesce(h / nullif(s, 0), 0) as precision, coalesce(h / nullif(t, 0), 0) as recall, coalesce(2 * h / nullif(s + t, 0), 0) as f1 from (select k, count(*) filter (y = k) as t, count(*) filter (p = k) as s, count(*) filter (y = k and p = k) as h from called, (select unnest([0, 1, 2]) as k) group by k) where s + t > 0"),
    "pair_acc": sql("logits", "pair_accuracy:f pairs:i", f"{ONE}, {CALLED} ;; select avg(r :: integer) as pair_accuracy, count(*) as pairs from (select id // 2, bool_and(p = y) as r from called group by 1)"),
    "kappa": sql("logits", "agreement:f kappa:f", f"{ONE}, {CALLED} ;; select o as agreement, (o - e) / nullif(1 - e, 0) as kappa from (select (select avg((p = y) :: integer) from called) as o, (select sum(a * b) from (select p as k, count(*) / (select count(*) from called) as a from called group by 1) join (select y as k, count(*) / (select count(*) from called) as b from called group by 1) using (k)) as e)"),
    "mcnemar_counts": sql("logits", "only_first:i only_second:i", f"{ONE}, {CALLED} ;; select count(*) filter (c.p = c.y and not o) as only_first, count(*) filter (c.p <> c.y and o) as only_second from called c join (select id, (case when zp > zn then 0 else 1 end) = y as o from logits) using (id)"),
    "qlike_table": sql("bars", "symbol subset n:i q1:f q2:f change:f", f"""{FC}, m as (select *, unnest(list_filter([case when d < date '1998-01-01' then 'early' end, case when d >= date '1998-01-01' then 'late' end, case when isodow(d) = 1 then 'monday' end, 'all'], lambda x: x is not null)) as subset from fc) ;;
      select *, 100 * (q2 / q1 - 1) as change from (select symbol, subset, count(*) as n, avg{QL('f1')} as q1, avg{QL('f2')} as q2 from m group by symbol, subset having count(*) >= 5)"""),
    "mz_r2": sql("bars", "symbol rmse_ln:f r2:f slope:f qlike:f n:i", f"{FC} ;; select symbol, sqrt(avg(power(ln(rv) - ln(f2), 2))) as rmse_ln, power(corr(rv, f2), 2) as r2, regr_slope(rv, f2) as slope, avg{QL('f2')} as qlike, count(*) as n from fc group by symbol"),
    "dm_test": sql("bars", "symbol n:i mean:f dm:f", f"""{FC}, dd as (select symbol, d, {QL('f2')} - {QL('f1')} as x from fc), e as (select *, x - avg(x) over (partition by symbol) as e from dd),
      l as (select *, {', '.join(f'lag(e, {k}) over w as l{k}' for k in range(1, 6))} from e window w as (partition by symbol order by d)) ;;
      select symbol, n, mean, case when v > 0 then mean / sqrt(v / n) else 0 end as dm from (select symbol, count(*) as n, avg(x) as mean, sum(e * e) / count(*) + {' + '.join(f'2 * (1 - {k} / 6.0 :: double) * sum(e * l{k}) / count(*)' for k in range(1, 6))} as v from l group by symbol)"""),
    "hit_rate": sql("bars", "symbol share:f n:i", f"{FC} ;; select symbol, avg((abs(ret) <= sqrt(f2)) :: integer) as share, count(*) as n from fc group by symbol"),
    "auc_rank": sql("bars", "symbol auc:f brier:f", f"{FC}, p as (select symbol, (abs(ret) > 100) :: integer as y, round(1 / (1 + exp(-ln(f2) / 10)), 2) as p from fc), r as (select *, {RANKS.format('p')} as r from p) ;; select symbol, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) as auc, avg(power(p - y, 2)) as brier from r group by symbol"),
    "spearman": sql("bars", "symbol rho:f n:i", f"{FC}, p as (select symbol, round(f2, 0) as x, round(rv, 0) as y from fc) ;; select symbol, corr(rx, ry) as rho, count(*) as n from (select symbol, {RANKS.format('x')} as rx, {RANKS.format('y')} as ry from p) group by symbol"),
    "welch_days": sql("bars articles", "symbol n1:i n0:i diff:f se:f t:f ratio:f", f"""{RV}, x as (select symbol, ln(rv) as x, d in (select d from articles where relevance = 1.0) as f from rv where rv > 0),
      g as (select symbol, count(*) filter (f) as n1, count(*) filter (not f) as n0, avg(x) filter (f) - avg(x) filter (not f) as diff, sqrt(var_samp(x) filter (f) / count(*) filter (f) + var_samp(x) filter (not f) / count(*) filter (not f)) as se from x group by symbol) ;; select *, diff / se as t, exp(diff) as ratio from g"""),
    "placebo_perm": sql("articles", "doc_id s:f", "select a.doc_id, b.s from (select *, row_number() over (partition by src order by doc_id) as r from articles) a join (select *, row_number() over (partition by src order by md5('7|' || doc_id), doc_id) as r from articles) b using (src, r)"),
    "quintile_means": sql("bars", "symbol q:i mean:f sem:f n:i", f"{FC} ;; select symbol, q, avg(ln(rv)) as mean, stddev_samp(ln(rv)) / sqrt(count(*)) as sem, count(*) as n from (select *, ntile(5) over (partition by symbol order by f2, d) as q from fc) group by symbol, q"),
    "subset_masks": sql("articles", "subset year:i n:i mean:f", f"{NEWS}, m as (select *, unnest(list_filter([case when starts_with(article_type, 'results') then 'results' end, case when role = 'primary' then 'primary' end, case when fb_t_net < -0.3 then 'negative' end, case when fb_t_net is null then 'no_score' end], lambda x: x is not null)) as subset from news) ;; select subset, year(day) as year, count(*) as n, avg(fb_t_net) as mean from m group by 1, 2 having count(*) >= 15"),
    "percentiles": sql("bars", "symbol lo:f mid:f hi:f", f"{FC} ;; select symbol, quantile_cont(rv, 0.025) as lo, quantile_cont(rv, 0.5) as mid, quantile_cont(rv, 0.975) as hi from fc group by symbol"),
    "histogram": sql("logits", "bucket:i n:i", f"{ONE}, {CALLED} ;; select case when conf < 0.3 then 0 when conf >= 1.0 then 8 else floor((conf - 0.3) / 0.7 * 7) + 1 end as bucket, count(*) as n from called group by 1"),
    "cluster_sums": sql("filings", "d:d total:f n:i", "select d, sum(value) as total, count(*) as n from filings group by d"),
    "label_precedence": sql("logits", "id label_source", "select id, case when id % 7 = 0 then 'user' when id % 3 = 0 then 'recheck' else 'draft' end as label_source from logits"),
    "single_ols": sql("bars", "symbol s:i n:i slope:f", f"{FC}, x as (select symbol, row_number() over (partition by symbol order by d) - 1 as t, ln(f2) as x, ln(rv) as y from fc), b as (select distinct symbol, t // 210 * 210 as s from x where t >= 210) ;; select b.symbol, s, count(*) as n, round(regr_slope(y, x), 4) as slope from b join x on x.symbol = b.symbol and x.t < b.s group by b.symbol, s"),
}
