"""Queries on expanding regressions, placebos, robust panels, temperatures and the streaming variance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import bars, calls, expanding, placebo, robust, study
from tidemark.operators import evaluate as ev
from tidemark.sources import views as v
from tidemark.sources.shared import shared_dir
from tidemark.streaming import garch, live


from .daily import RV
from .inferences import _implied
from .networks import ORACLE as NETWORKS
from .networks import PHI
from .scores import FC, QL, _forecasts
from .tidy import sql, tidy


def _u(spark, sf):
    return _forecasts(spark, sf).select("symbol", "d", F.ln(F.col("rv") / F.col("f2")).alias("u"), F.ln("f1").alias("x"), F.col("f2").alias("base"))


def ols_one_walk(spark, sf):
    return tidy(expanding.ols(_u(spark, sf), "symbol", "u", ["x"], "base"))


def _panel(spark, sf):
    """Filings as a panel: the log value against two features of the order, by company and priority."""
    f = v.filings(spark, sf)
    return f.select("id", "d", "symbol", "group", F.ln(F.col("value")).alias("u"), (F.col("id") % 13).cast("double").alias("size"), (F.col("id") % 37 + F.col("value") / 50000).alias("tone"))


def ols_by_year(spark, sf):
    return tidy(expanding.by_year(_panel(spark, sf), "u", ["tone"]))


def mean_by_year(spark, sf):
    return tidy(expanding.by_year(_panel(spark, sf), "u", [], "logit"))


SCHEMES = {"group and year": ["group", "year"], "group and company": ["group", "symbol"]}


def placebo_refits(spark, sf):
    return tidy(placebo.refitted(_panel(spark, sf), "u", [], ["tone"], SCHEMES, replicates=20))


def placebo_shares(spark, sf):
    fits = placebo.refitted(_panel(spark, sf), "u", ["size"], ["tone"], SCHEMES, replicates=20)
    return tidy(placebo.shares(fits))


def best_temperature(spark, sf):
    """Classes that three in four logits tell right, so that the best temperature lies inside the interval."""
    z = v.logits(spark, sf)
    right = ev.argmax([F.col("zp"), F.col("zn"), F.col("zu")], [0, 1, 2]).cast("long")
    z = z.withColumn("k", F.when(F.col("id") % 4 == 0, F.col("y")).otherwise(right))
    t = ev.fit_temperature(z, ["zp", "zn", "zu"], "k")
    return z.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(t), 2).alias("temperature"))


def robust_one(spark, sf):
    """Both kinds of errors for one feature."""
    x = _u(spark, sf).join(_forecasts(spark, sf).select("symbol", "d", "rv"), ["symbol", "d"]).select("symbol", "d", F.ln("rv").alias("y"), "x")
    parts = [robust.regression(x, "symbol", "y", ["x"], lags).withColumn("kind", F.lit(kind)) for kind, lags in (("HC3", None), ("lags", 5))]
    return tidy(parts[0].unionByName(parts[1]).select("symbol", "kind", "coefficient", "error", "p"))


def implied_periods(spark, sf):
    x = _implied(spark, sf).withColumn("u", F.ln(F.col("rv_target") / F.col("f2"))).withColumn("li", F.ln("implied")).withColumn("lf", F.ln("f1"))
    a, b = (expanding.ols(x.select("symbol", "d", "u", "f2", f), "symbol", "u", [f], "f2").select("symbol", "d", F.col("forecast").alias(n)) for n, f in (("har", "lf"), ("iv", "li")))
    j = x.select("symbol", "d", "rv_target", "f2").join(a, ["symbol", "d"]).join(b, ["symbol", "d"])
    return tidy(ev.ladder(j, "symbol", "rv_target", ["f2", "har", "iv"], "f2", "1999-01-01"))


def stream_garch(spark, sf):
    r = bars.realised(v.bars(spark, sf)).select("symbol", "d", (F.col("ret") / 100).alias("ret"))
    root = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    for k, part in enumerate(("d < '1995-01-01'", "d >= '1995-01-01' and d < '1998-01-01'", "d >= '1998-01-01'")):  # in order, as days come in
        r.filter(part).coalesce(1).write.parquet(f"{root}/in/part={k}")
    rows = live.file_stream(spark, f"{root}/in/*", r.schema)
    garch.garch(rows, f"{root}/out", f"{root}/checkpoint", fixed=(0.0, 0.05, 0.1, 0.85, 0.0, 1.0)).awaitTermination()
    return tidy(spark.read.schema(garch.OUT).parquet(f"{root}/out"))


def event_spillover(spark, sf):
    """Days on which a symbol trades half as much again as on average are its events."""
    b = v.bars(spark, sf)
    busy = b.join(b.groupBy("symbol").agg(F.avg("v").alias("mean")), "symbol").filter(F.col("v") > 1.5 * F.col("mean"))
    x = bars.realised(b).select(F.col("symbol").alias("name"), "d", F.ln("rv").alias("x"))
    return tidy(study.event_day_spillover(x, busy.select(F.col("symbol").alias("name"), "d"), "x"))


def call_windows(spark, sf):
    b = v.bars(spark, sf)
    x = bars.realised(b).select("symbol", "d", F.ln("rv").alias("x"))
    filed = v.filings(spark, sf).select(F.translate("sub", "OFP", "ANR").alias("symbol"), "d", "id")
    return tidy(calls.window_panel(filed, x, v.calendar(b), "symbol", "x").select("id", "symbol", "d", "x_1d", "x_5d", "x_10d"))


QUERIES = {f.__name__: f for f in (ols_one_walk, ols_by_year, mean_by_year, placebo_refits, placebo_shares, best_temperature, robust_one, implied_periods, stream_garch, event_spillover, call_windows)}

#: A walk with one feature, by block: columns symbol, d, u, x, base in `rows`.
WALK = lambda rows, name="walked": f"""{name}_t as (select *, row_number() over (partition by symbol order by d) - 1 as t from {rows} where x is not null and base is not null),
{name}_b as (select symbol, unnest(range(120, max(t) + 1, 21)) as s from {name}_t group by symbol having max(t) >= 120),
{name}_f as (select b.symbol, s, coalesce(regr_slope(u, x), 0) as w, avg(u) filter (x is not null) as my, avg(x) filter (u is not null) as mx, count(u) as n, coalesce(regr_syy(u, x) - power(regr_sxy(u, x), 2) / regr_sxx(u, x), 0) as ssr from {name}_b b join {name}_t t on t.symbol = b.symbol and t.t < b.s group by b.symbol, s having count(u) > 0),
{name} as (select t.symbol, t.d, my + w * (x - mx) as u_hat, base * exp(my + w * (x - mx) + ssr / greatest(n - 2, 1) / 2) as forecast from {name}_t t join {name}_f f on f.symbol = t.symbol and t.t >= f.s and t.t < f.s + 21)"""  # noqa: E731
PANEL = 'panel as (select id, d, year(d) as year, symbol, "group", ln(value) as u, id % 13 :: double as size, id % 37 + value / 50000 as tone from filings)'
#: Real and dealt panels, for both schemes and 20 replicates.
DEALT = PANEL + """, rep as (select unnest(range(20)) as rep), own as (select *, row_number() over (partition by "group", year order by id) as ry, row_number() over (partition by "group", symbol order by id) as rs from panel),
md as (select p.*, rep, md5('7|' || rep || '|' || id) as o from panel p, rep), moved as (select *, row_number() over (partition by rep, "group", year order by o, id) as oy, row_number() over (partition by rep, "group", symbol order by o, id) as os from md),
dealt as (select 'group and year' as scheme, rep, a.year, a.u, a.size, b.tone from own a join moved b on a."group" = b."group" and a.year = b.year and a.ry = b.oy
  union all select 'group and company', rep, a.year, a.u, a.size, b.tone from own a join moved b on a."group" = b."group" and a.symbol = b.symbol and a.rs = b.os
  union all select scheme, -1, year, u, size, tone from panel, (select unnest(['group and year', 'group and company']) as scheme)),
yrs as (select distinct year from panel)"""
ORACLE = {
    "ols_one_walk": sql("bars", "symbol d:d u_hat:f forecast:f", f"{FC}, x0 as (select symbol, d, ln(rv / f2) as u, ln(f1) as x, f2 as base from fc), {WALK('x0')} ;; select * from walked"),
    "ols_by_year": sql("filings", "id p:f s2:f", f"""{PANEL}, y as (select distinct year as "of" from panel), f as (select "of", regr_slope(u, tone) as w, regr_intercept(u, tone) as c, (regr_syy(u, tone) - power(regr_sxy(u, tone), 2) / regr_sxx(u, tone)) / count(*) as s2 from y join panel on year < "of" group by "of" having count(*) >= 50) ;; select id, c + w * tone as p, s2 from panel join f on "of" = year"""),
    "mean_by_year": sql("filings", "id p:f s2:f", f"""{PANEL}, y as (select distinct year as "of" from panel), f as (select "of", avg(u) as p from y join panel on year < "of" group by "of" having count(*) >= 50) ;; select id, p, cast(null as double) as s2 from panel join f on "of" = year"""),
    "placebo_refits": sql("filings", "scheme rep:i n:i mse:f", f"""{DEALT}, f as (select scheme, rep, yrs.year as y, regr_slope(u, tone) as w, regr_intercept(u, tone) as c from yrs join dealt on dealt.year < yrs.year group by 1, 2, 3 having count(*) >= 50) ;; select scheme, rep, count(*) as n, avg(power(u - c - w * tone, 2)) as mse from dealt join f using (scheme, rep) where f.y = dealt.year group by 1, 2"""),
    "placebo_shares": sql("filings", "scheme n:i real:f placebo:f share:f", f"""{DEALT}, m as (select scheme, rep, yrs.year as y, count(*) as n, avg(u) as mu, avg(size) as ms, avg(tone) as mt, covar_pop(size, size) as ss, covar_pop(tone, tone) as tt, covar_pop(size, tone) as st, covar_pop(size, u) as su, covar_pop(tone, u) as tu from yrs join dealt on dealt.year < yrs.year group by 1, 2, 3 having count(*) >= 50),
      f as (select *, (su * tt - tu * st) / (ss * tt - st * st) as a, (tu * ss - su * st) / (ss * tt - st * st) as b from m), e as (select scheme, rep, count(*) as n, avg(power(u - mu - a * (size - ms) - b * (tone - mt), 2)) as mse from dealt join f using (scheme, rep) where f.y = dealt.year group by 1, 2) ;;
      select e.scheme, r.n, r.mse as real, avg(e.mse) as placebo, avg((e.mse <= r.mse) :: integer) as share from e join (select * from e where rep < 0) r on r.scheme = e.scheme where e.rep >= 0 group by 1, 2, 3"""),
    "best_temperature": sql("logits", "n temperature", """t as (select exp(ln(0.05 :: double) + i * 0.00002 :: double) as t from range(345388) u(i)), z as (select zp, zn, zu, greatest(zp, zn, zu) as m, case when id % 4 = 0 then case y when 0 then zp when 1 then zn else zu end else greatest(zp, zn, zu) end as own from logits),
      coarse as (select exp(ln(0.05 :: double) + i * 0.01 :: double) as t from range(691) u(i)), c as (select t, avg(ln(exp((zp - m) / t) + exp((zn - m) / t) + exp((zu - m) / t)) - (own - m) / t) as l from coarse, z group by t), b as (select arg_min(t, l) as t from c),
      fine as (select t.t from t, b where t.t between b.t * 0.985 and b.t * 1.015), g as (select t, avg(ln(exp((zp - m) / t) + exp((zn - m) / t) + exp((zu - m) / t)) - (own - m) / t) as l from fine, z group by t) ;;
      select (select count(*) from logits) as n, round((select arg_min(t, l) from g), 2) as temperature"""),
    "stream_garch": NETWORKS["garch_filter"],
}
LAGS = range(1, 6)
ORACLE["robust_one"] = sql("bars", "symbol kind coefficient:f error:f p:f", f"""{FC}, r as (select symbol, d, ln(rv) as y, ln(f1) as x0 from fc), z as (select symbol, d, y - avg(y) over w as y, (x0 - avg(x0) over w) / stddev_samp(x0) over w as x from r window w as (partition by symbol)),
      b as (select symbol, count(*) as n, sum(x * x) as xx, sum(x * y) / sum(x * x) as b from z group by symbol), e as (select symbol, d, x, y - b * x as e, n, xx, b, 1 - 1 / n - x * x / xx as rest from z join b using (symbol)),
      s as (select *, x * e as s, {', '.join(f'lag(x * e, {k}) over (partition by symbol order by d) as s{k}' for k in LAGS)} from e),
      m as (select symbol, any_value(b) as coefficient, any_value(xx) as xx, sum(power(x * e / rest, 2)) as hc, sum(s * s) + {' + '.join(f'2 * (1 - {k} / 6.0 :: double) * sum(s * s{k})' for k in LAGS)} as nw from s group by symbol),
      u as (select symbol, unnest(['HC3', 'lags']) as kind, coefficient, sqrt(unnest([hc, nw])) / xx as error from m) ;; select *, 2 * {PHI('(-abs(coefficient / error))')} as p from u""")
ORACLE["panel_fixed_effects"] = sql("bars", "feature coefficient:f error:f p:f n:i", f"""{FC}, har as (select symbol, d, ln(rv_target) as y, ln(rv) as lrv_d, case when count(rv) over w5 = 5 then ln(avg(rv) over w5) end as lrv_w, case when count(rv) over w22 = 22 then ln(avg(rv) over w22) end as lrv_m from fc window w5 as (partition by symbol order by d rows 4 preceding), w22 as (partition by symbol order by d rows 21 preceding)),
      l as (select * from (select symbol, y, unnest(['lrv_d', 'lrv_w', 'lrv_m']) as feature, unnest([lrv_d, lrv_w, lrv_m]) as x from har) where x is not null and y is not null),
      c as (select feature, stddev_samp(x) over (partition by feature) as sd, count(*) over (partition by feature) as total, count(*) over g as n, x - avg(x) over g as x, y - avg(y) over g as y from l window g as (partition by feature, symbol)),
      b as (select feature, sum(x * x) as xx, sum(x * y) / sum(x * x) as b from c group by feature), m as (select feature, any_value(b) * any_value(sd) as coefficient, sqrt(sum(power(x * (y - b * x) / (1 - 1 / n - x * x / xx), 2))) / any_value(xx) * any_value(sd) as error, any_value(total) as n from c join b using (feature) group by feature)
      ;; select *, 2 * {PHI('(-abs(coefficient / error))')} as p from m""")
ORACLE["implied_periods"] = sql("bars", "symbol period model n:i qlike:f change:f dm:f p:f", f"""{FC}, iv0 as (select cast(o_orderdate as date) as d, avg(o_orderkey % 37) / 10 + 1 as implied from orders group by 1), x1 as (select *, rv_target as target from fc join iv0 using (d)),
      h0 as (select symbol, d, ln(target / f2) as u, ln(f1) as x, f2 as base from x1), i0 as (select symbol, d, ln(target / f2) as u, ln(implied) as x, f2 as base from x1), {WALK('h0', 'har')}, {WALK('i0', 'iv')},
      j as (select x1.symbol, x1.d, target as rv, f2, har.forecast as har, iv.forecast as iv from x1 join har using (symbol, d) join iv using (symbol, d) where target > 0 and f2 > 0 and har.forecast > 0 and iv.forecast > 0),
      q as (select symbol, d, rv, f2, unnest(['f2', 'har', 'iv']) as model, unnest([f2, har, iv]) as f from j),
      l as (select symbol, case when d < date '1999-01-01' then 'validation' else 'test' end as period, d, model, {QL('f')} as loss, {QL('f2')} as base from q),
      e as (select *, loss - base - avg(loss - base) over (partition by symbol, period, model) as e from l),
      g as (select *, {', '.join(f'lag(e, {k}) over w as e{k}' for k in LAGS)} from e window w as (partition by symbol, period, model order by d)),
      s as (select symbol, period, model, count(*) as n, avg(loss) as qlike, avg(base) as base, avg(loss - base) as m, (sum(e * e) + {' + '.join(f'2 * (1 - {k} / 6.0 :: double) * coalesce(sum(e * e{k}), 0)' for k in LAGS)}) / count(*) as v from g group by 1, 2, 3 having count(*) >= 20),
      dm as (select *, case when model = 'f2' then null when v > 0 then m / sqrt(v / n) else 0 end as dm from s)
      ;; select symbol, period, model, n, qlike, 100 * (qlike / base - 1) as change, dm, 2 * {PHI('(-abs(dm))')} as p from dm""")
ORACLE["event_spillover"] = sql("bars", "reporter affected own n_days:i mean_on:f mean_other:f excess:f t:f ratio:f", f"""{RV}, x as (select symbol as name, d, ln(rv) as x from rv), e as (select symbol as name, d from (select *, avg(v) over (partition by symbol) as m from bars) where v > 1.5 :: double * m),
      o as (select name as affected, avg(x) as mean_other, var_samp(x) as v0, count(*) as n0 from x where d not in (select d from e) group by name),
      m as (select e.name as reporter, x.name as affected, x.x from x join e using (d) where x.name = e.name or not exists (select 1 from e q where q.name = x.name and q.d = x.d)),
      g as (select reporter, affected, count(*) as n_days, avg(x) as mean_on, var_samp(x) as v1 from m group by 1, 2 having count(*) >= 5)
      ;; select *, reporter = affected as own, mean_on - mean_other as excess, (mean_on - mean_other) / sqrt(v1 / n_days + v0 / n0) as t, exp(mean_on - mean_other) as ratio from g join o using (affected)""")
ORACLE["call_windows"] = sql("bars cal", "id symbol d:d x_1d:f x_5d:f x_10d:f", f"""{RV}, x as (select symbol, d, {', '.join(f'case when count(*) over (partition by symbol order by d rows between current row and {h - 1} following) = {h} then avg(ln(rv)) over (partition by symbol order by d rows between current row and {h - 1} following) end as x_{h}d' for h in (1, 5, 10))} from rv),
      f as (select o_orderkey as id, translate(o_orderstatus, 'OFP', 'ANR') as symbol, cast(o_orderdate as date) as d from orders join customer on c_custkey = o_custkey), r as (select f.*, c.d as row_d from f asof join cal c on c.d <= f.d)
      ;; select r.id, r.symbol, r.d, x_1d, x_5d, x_10d from r left join x on x.symbol = r.symbol and x.d = r.row_d""")
