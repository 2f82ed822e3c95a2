"""Queries on graphs, spillovers, options and walk-forward kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import numeric as nm
from tidemark.operators import bars, graph, options, walk
from tidemark.sources import views as v

from .daily import RV
from .scores import _forecasts
from .tidy import sql, tidy

LEAST = 3


def _edges(spark, sf):
    return graph.comentions(v.mentions(spark, sf))


EDGES = 'edges as (select a.name as source, b.name as target, count(*) as weight from mentions a join mentions b on a.item = b.item and a.name < b.name group by 1, 2)'
BOTH = "two as (select source, target, weight from edges union all select target, source, weight from edges)"


def comention_edges(spark, sf):
    return tidy(_edges(spark, sf))


def degree_strength(spark, sf):
    return tidy(graph.degrees(_edges(spark, sf)))


def triangles(spark, sf):
    return tidy(graph.triangles(_edges(spark, sf)))


def transitivity(spark, sf):
    return tidy(graph.transitivity(_edges(spark, sf)))


def components(spark, sf):
    return tidy(graph.components(_edges(spark, sf)))


def pagerank_fixed_iter(spark, sf):
    return tidy(graph.pagerank(_edges(spark, sf)))


def assortativity(spark, sf):
    return tidy(graph.assortativity(_edges(spark, sf)))


def rank_nodes(spark, sf):
    return tidy(graph.ranked(graph.degrees(_edges(spark, sf)), "strength"))


def monthly_focus(spark, sf):
    dates = v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.to_date("o_orderdate").alias("d"))
    return tidy(graph.monthly_focus(v.mentions(spark, sf), dates, "Brand#11"))


def _small(spark, sf):
    """The edges of a network of few names, gathered once; the names are a fixed list of brands."""
    rows = _edges(spark, sf).collect()
    e = {(r["source"], r["target"]): r["weight"] for r in rows}
    return sorted({n for p in e for n in p}), e


def betweenness(spark, sf):
    nodes, e = _small(spark, sf)
    b = nm.betweenness(nodes, {k: 1.0 / w for k, w in e.items()})
    return tidy(spark.createDataFrame(list(b.items()) or [], "name string, betweenness double"))


def modularity(spark, sf):
    groups, q = nm.greedy_communities(*_small(spark, sf))
    return tidy(spark.createDataFrame([(n, i, q) for i, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))) for n in sorted(g)], "name string, community long, modularity double"))


def _shares(spark, sf):
    """Shares made of co-mention weights, so that they are the same in SQL."""
    two = graph.both_ways(_edges(spark, sf))
    own = v.mentions(spark, sf).groupBy(F.col("name").alias("source")).agg(F.count(F.lit(1)).alias("weight")).select("source", F.col("source").alias("target"), "weight")
    all_ = two.select("source", "target", "weight").unionByName(own)
    total = all_.groupBy("target").agg(F.sum("weight").alias("total"))
    return all_.join(total, "target").select("target", "source", (F.col("weight") / F.col("total")).alias("share"))


SHARES = """edges as (select a.name as source, b.name as target, count(*) as weight from mentions a join mentions b on a.item = b.item and a.name <> b.name group by 1, 2 union all select name, name, count(*) from mentions group by name),
shares as (select target, source, weight / sum(weight) over (partition by target) as share from edges)"""


def connectedness_table(spark, sf):
    return tidy(graph.connectedness(_shares(spark, sf)))


def pairwise_net(spark, sf):
    return tidy(graph.pairwise_net(_shares(spark, sf)))


def gfevd(spark, sf):
    """Shares of a VAR of the three series' log variances; the panel is one row for each day."""
    nodes = ["A", "N", "R"]
    panel = bars.panel(bars.realised(v.bars(spark, sf)), nodes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        theta = nm.gfevd(pdf.sort_values("d")[nodes].to_numpy(float))
        return pd.DataFrame([(a, b, theta[i, j]) for i, a in enumerate(nodes) for j, b in enumerate(nodes)], columns=["target", "source", "share"])

    return tidy(panel.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "target string, source string, share double"))


def rolling_spillover(spark, sf):
    panel = bars.panel(bars.realised(v.bars(spark, sf)), ["A", "N", "R"])
    return tidy(walk.rolling_connectedness(panel, ["A", "N", "R"]))


def _chain(spark, sf):
    """A chain from parts: a call and a put at each strike around a forward, priced so that parity holds."""
    f, p = 1000.0, v.read(spark, sf, "part")
    days = (F.col("p_partkey") % 4 * 20 + 10).cast("int")
    k = F.lit(f) * (0.8 + 0.02 * (F.col("p_partkey") % 21))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 50).cast("int"))
    t = days / 365.0
    put = F.greatest(k - f, F.lit(0.0)) + F.lit(f) * (0.05 + 0.002 * (F.col("p_partkey") % 13)) * F.sqrt(t) * F.exp(-F.pow(F.ln(k / f), 2) * 20)
    call = put + F.exp(F.lit(-0.065) * t) * (F.lit(f) - k)
    symbol = F.element_at(F.array(*map(F.lit, ("X", "Y", "Z"))), (F.floor(F.col("p_partkey") / 7) % 3 + 1).cast("int"))
    base = p.select(date.alias("date"), symbol.alias("symbol"), F.lit("option").alias("kind"), F.date_add(date, days).alias("expiry"), k.alias("strike"), put.alias("put"), call.alias("call"))
    one = base.groupBy("date", "symbol", "kind", "expiry", "strike").agg(F.max("put").alias("put"), F.max("call").alias("call"))
    chain = one.select("date", "symbol", "kind", "expiry", "strike", F.explode(F.create_map(F.lit("put"), F.col("put"), F.lit("call"), F.col("call"))).alias("cp", "close")).withColumns({"settle": F.col("close"), "underlying": F.lit(f), "oi": F.lit(1.0), "volume": F.lit(10.0)})
    # Futures of one symbol, of which every second expiry's is not traded.
    futures = one.filter("symbol = 'Z'").select("date", "symbol", F.lit("future").alias("kind"), "expiry", F.lit(None).cast("double").alias("strike"), F.lit("").alias("cp"), F.lit(f + 7).alias("close")).distinct()
    futures = futures.withColumns({"settle": F.col("close"), "underlying": F.lit(f), "oi": F.lit(1.0), "volume": F.when(F.dayofmonth("expiry") % 2 == 0, 5.0).otherwise(0.0)})
    return chain.unionByName(futures)


CHAIN = """c0 as (select cast(date '2024-01-01' + cast(p_partkey % 50 as integer) as date) as date, p_partkey % 4 * 20 + 10 as days, 1000.0 :: double * (0.8 :: double + 0.02 :: double * (p_partkey % 21)) as strike, p_partkey % 13 as m, ['X', 'Y', 'Z'][p_partkey // 7 % 3 + 1] as symbol from part),
c1 as (select symbol, date, cast(date + cast(days as integer) as date) as expiry, days / 365.0 :: double as t, strike, greatest(strike - 1000, 0) + 1000 * (0.05 :: double + 0.002 :: double * m) * sqrt(days / 365.0 :: double) * exp(-power(ln(strike / 1000.0 :: double), 2) * 20) as put from c0),
c2 as (select symbol, date, expiry, strike, max(put) as put, max(put + exp(-0.065 :: double * t) * (1000 - strike)) as call from c1 group by symbol, date, expiry, strike)"""


def forward_parity(spark, sf):
    return tidy(options.forward(_chain(spark, sf)))


def surface_slice(spark, sf):
    return tidy(options.surface(_chain(spark, sf)))


def _slices(spark, sf):
    o = v.read(spark, sf, "orders")
    return o.select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 90 + 3).cast("int").alias("days"), (0.1 + (F.col("o_orderkey") % 37) / 100.0).alias("atm"), F.translate("o_orderstatus", "OFP", "ANR").alias("symbol"), (F.col("o_orderkey") % 11 / 100.0).alias("skew"), (F.col("o_orderkey") % 17 + 100.0).alias("F")).groupBy("symbol", "date", "days").agg(F.max("atm").alias("atm"), F.max("skew").alias("skew"), F.max("F").alias("F"))


def iv30_interp(spark, sf):
    return tidy(options.constant_maturity(_slices(spark, sf)))


def vrp_summary(spark, sf):
    iv = options.constant_maturity(_slices(spark, sf)).select("symbol", F.col("date").alias("d"), (F.col("iv30") * 100).alias("implied"))
    r = bars.realised(v.bars(spark, sf)).withColumn("vol", F.sqrt("rv"))
    return tidy(options.premium(r.join(iv, ["symbol", "d"]), "implied", "vol", "symbol"))


def _options(spark, sf):
    p = v.read(spark, sf, "part")
    return p.select("p_partkey", F.col("p_retailprice").alias("f"), (F.col("p_size") / 365.0).alias("t"), (F.col("p_retailprice") * (0.8 + 0.02 * (F.col("p_partkey") % 21))).alias("k"), (0.1 + 0.01 * (F.col("p_partkey") % 40)).alias("sigma"))


def black76(spark, sf):
    return tidy(options.priced(_options(spark, sf), "f", "k", "t", "sigma").select("p_partkey", "call", "put"))


def greeks(spark, sf):
    return tidy(options.priced(_options(spark, sf), "f", "k", "t", "sigma").select("p_partkey", "delta", "gamma", "vega", "theta"))


def implied_vol(spark, sf):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"p_partkey": b.p_partkey, "iv": nm.implied_vol(b.price, b.f, b.k, b.t, 0.065)})

    priced = options.priced(_options(spark, sf), "f", "k", "t", "sigma").withColumn("price", F.col("call"))
    return tidy(priced.mapInPandas(run, "p_partkey long, iv double"))


def garch_filter(spark, sf):
    r = bars.realised(v.bars(spark, sf)).select("symbol", "d", (F.col("ret") / 100).alias("ret"))
    return tidy(walk.garch_fixed(r, "symbol", 0.0, 0.05, 0.1, 0.85, 1.0))


def ols_multi_walk(spark, sf):
    f = bars.har(_forecasts(spark, sf)).withColumn("u", F.ln(F.col("rv_target") / F.col("f2")))
    return tidy(walk.ols(f.select("symbol", "d", "u", "f2", "lrv_d", "lrv_w", "lrv_m"), "symbol", "u", ["lrv_d", "lrv_w", "lrv_m"], "f2"))


def logit_walk(spark, sf):
    id_ = F.datediff("d", F.lit("1990-01-01").cast("date")).cast("long") * 128 + F.ascii("symbol")
    f = _forecasts(spark, sf).select(id_.alias("id"), "d", (F.abs("ret") > 100).cast("double").alias("y"), F.ln("f1").alias("a"), F.ln("f2").alias("b"))
    return tidy(walk.by_year(f, "y", ["a", "b"], "logit").select("id", "p"))


def _dated(spark, sf):
    dates = v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.year("o_orderdate").alias("year"))
    return graph.grouped_comentions(v.mentions(spark, sf).join(dates, "item"), "year")


def yearly_nodes(spark, sf):
    return tidy(graph.grouped_nodes(_dated(spark, sf)))


def yearly_network(spark, sf):
    return tidy(graph.grouped_metrics(_dated(spark, sf)))


QUERIES = {f.__name__: f for f in (comention_edges, degree_strength, triangles, transitivity, components, pagerank_fixed_iter, assortativity, rank_nodes, monthly_focus, betweenness, modularity, connectedness_table, pairwise_net, gfevd, rolling_spillover, forward_parity, surface_slice, iv30_interp, vrp_summary, black76, greeks, implied_vol, garch_filter, ols_multi_walk, logit_walk, yearly_nodes, yearly_network)}


def _rank_sql(rounds: int) -> str:
    steps = ["r0 as (select source as name, 1.0 :: double / (select count(*) from w) as rank from w)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} as (select w.source as name, 0.15 :: double / (select count(*) from w) + 0.85 :: double * coalesce(g, 0) as rank from w left join (select target as name, sum(weight / total * rank) as g from two join w using (source) join r{i} on r{i}.name = two.source group by target) g on g.name = w.source)")
    return f"{EDGES}, {BOTH}, w as (select source, sum(weight) :: double as total from two group by source), {', '.join(steps)} ;; select * from r{rounds}"


TRI = "tri as (select a.source as a, a.target as b, b.target as c from edges a join edges b on a.target = b.source join edges c on c.source = a.source and c.target = b.target), per as (select name, count(*) as t from (select unnest([a, b, c]) as name from tri) group by name), deg as (select source as name, count(*) as k from two group by source)"
#: Phi as the series of exp(-x²) x^(2n+1) / Gamma(n + 3/2), which has no negative terms; in the far tails 0 or 1.
PHI = lambda z: f"(case when abs({z}) > 7.5 then ({z} > 0) :: integer :: double when {z} = 0 then 0.5 :: double else 0.5 :: double + 0.5 :: double * sign({z}) * list_sum(list_transform(range(150), lambda n: exp((2 * n + 1) * ln(abs({z}) / sqrt(2.0 :: double)) - lgamma(n + 1.5 :: double) - {z} * {z} / 2))) end)"
PRICED = """o as (select p_partkey, p_retailprice as f, p_size / 365.0 :: double as t, p_retailprice * (0.8 :: double + 0.02 :: double * (p_partkey % 21)) as k, 0.1 :: double + 0.01 :: double * (p_partkey % 40) as sigma from part),
o1 as (select *, (ln(f / k) + sigma * sigma * t / 2) / (sigma * sqrt(t)) as d1, exp(-0.065 :: double * t) as disc from o), o2 as (select *, d1 - sigma * sqrt(t) as d2 from o1),
o3 as (select *, """ + f"{PHI('d1')} as n1, {PHI('d2')} as n2, " + """exp(-d1 * d1 / 2) / sqrt(2 * pi()) as density from o2), o4 as (select *, disc * (f * n1 - k * n2) as call from o3)"""
YEARLY = "e as (select cast(year(o_orderdate) as varchar) as grp, a.name as source, b.name as target, count(*) as weight from mentions a join mentions b on a.item = b.item and a.name < b.name join orders on o_orderkey = a.item group by 1, 2, 3), e2 as (select * from e union all select grp, target, source, weight from e), deg as (select grp, source as name, count(*) as degree, sum(weight) as strength from e2 group by 1, 2), size as (select grp, count(*) as n from deg group by grp), closed as (select a.grp, a.source as a, a.target as b, b.target as c from e a join e b on a.grp = b.grp and a.target = b.source join e c on c.grp = a.grp and c.source = a.source and c.target = b.target), per as (select grp, name, count(*) as t from (select grp, unnest([a, b, c]) as name from closed) group by 1, 2), nodes as (select deg.grp, name, degree, strength, degree / (n - 1) :: double as centrality, coalesce(t, 0) as triangles, coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0) as clustering from deg join size using (grp) left join per using (grp, name))"
ORACLE = {
    "black76": sql("", "p_partkey call:f put:f", PRICED + " ;; select p_partkey, call, call - disc * (f - k) as put from o4"),
    "greeks": sql("", "p_partkey delta:f gamma:f vega:f theta:f", PRICED + " ;; select p_partkey, disc * n1 as delta, disc * density / (f * sigma * sqrt(t)) as gamma, disc * f * density * sqrt(t) as vega, 0.065 :: double * call - disc * f * density * sigma / (2 * sqrt(t)) as theta from o4"),
    "yearly_nodes": sql("mentions", '"group" name degree:i strength:i centrality:f triangles:i clustering:f', YEARLY + ' ;; select grp as "group", name, degree, strength, centrality, triangles, clustering from nodes'),
    "yearly_network": "with recursive " + sql("mentions", '"group" metric value:f', YEARLY + """, reach as (select distinct grp, source as name, source as here from e2 union select reach.grp, reach.name, e2.target from reach join e2 on e2.grp = reach.grp and e2.source = reach.here), comp as (select grp, component, count(*) as size from (select grp, name, min(here) as component from reach group by 1, 2) group by 1, 2),
      f as (select grp, count(*) :: double as nodes, sum(degree) / 2 :: double as edges, coalesce(sum(degree) / nullif(count(*) * (count(*) - 1), 0) :: double, 0) as density, avg(degree) :: double as mean_degree, avg(strength) :: double as mean_strength, max(centrality) :: double as max_centrality, avg(clustering) :: double as clustering, coalesce(2.0 * sum(triangles) / nullif(sum(degree * (degree - 1)), 0), 0) :: double as transitivity from nodes group by grp),
      m as (select e2.grp, corr(x.degree, y.degree) as assortativity from e2 join deg x on x.grp = e2.grp and x.name = e2.source join deg y on y.grp = e2.grp and y.name = e2.target group by 1), c as (select grp, count(*) :: double as components, max(size) :: double as giant from comp group by grp) ;;
      select grp as "group", unnest(['nodes', 'edges', 'density', 'mean_degree', 'mean_strength', 'max_centrality', 'clustering', 'transitivity', 'assortativity', 'components', 'giant']) as metric, unnest([nodes, edges, density, mean_degree, mean_strength, max_centrality, clustering, transitivity, case when isnan(assortativity) then null else assortativity end, components, giant]) as value from f join m using (grp) join c using (grp)""").removeprefix("with "),
    "comention_edges": sql("mentions", "source target weight:i", f"{EDGES} ;; select * from edges"),
    "degree_strength": sql("mentions", "name degree:i strength:i", f"{EDGES}, {BOTH} ;; select source as name, count(*) as degree, sum(weight) as strength from two group by source"),
    "triangles": sql("mentions", "name triangles:i clustering:f", f"{EDGES}, {BOTH}, {TRI} ;; select name, coalesce(t, 0) as triangles, coalesce(2.0 * coalesce(t, 0) / nullif(k * (k - 1), 0), 0) as clustering from deg left join per using (name)"),
    "transitivity": sql("mentions", "transitivity:f nodes:i edges:i", f"{EDGES}, {BOTH}, {TRI} ;; select coalesce(2.0 * sum(coalesce(t, 0)) / nullif(sum(k * (k - 1)), 0), 0) as transitivity, count(*) as nodes, sum(k) / 2 as edges from deg left join per using (name)"),
    "components": "with recursive " + sql("mentions", "name component", f"""{EDGES}, {BOTH}, reach as (select distinct source as name, source as here from two union select reach.name, two.target from reach join two on two.source = reach.here) ;; select name, min(here) as component from reach group by name""").removeprefix("with "),
    "pagerank_fixed_iter": sql("mentions", "name rank:f", _rank_sql(20)),
    "assortativity": sql("mentions", "assortativity:f", f"{EDGES}, {BOTH}, deg as (select source as name, count(*) as k from two group by source) ;; select corr(x.k, y.k) as assortativity from two join deg x on x.name = source join deg y on y.name = target"),
    "rank_nodes": sql("mentions", "name degree:i strength:i rank:i", f"{EDGES}, {BOTH} ;; select *, rank() over (order by strength desc) as rank from (select source as name, count(*) as degree, sum(weight) as strength from two group by source)"),
    "monthly_focus": sql("mentions", "month partners:i strength:i share:f", """e as (select strftime(o_orderdate, '%Y-%m') as month, a.name as source, b.name as target, count(*) as weight from mentions a join mentions b on a.item = b.item and a.name < b.name join orders on o_orderkey = a.item group by 1, 2, 3) ;;
      select month, count(*) filter (source = 'Brand#11' or target = 'Brand#11') as partners, coalesce(sum(weight) filter (source = 'Brand#11' or target = 'Brand#11'), 0) as strength, coalesce(sum(weight) filter (source = 'Brand#11' or target = 'Brand#11'), 0) / sum(weight) as share from e group by month"""),
    "connectedness_table": sql("mentions", "node from_others:f own:f to_others:f net:f", f"{SHARES} ;; select node, from_others, own, to_others, to_others - from_others as net from (select target as node, coalesce(sum(share) filter (source <> target), 0) as from_others, coalesce(sum(share) filter (source = target), 0) as own from shares group by target) join (select source as node, coalesce(sum(share) filter (source <> target), 0) as to_others from shares group by source) using (node)"),
    "pairwise_net": sql("mentions", "source target flow:f", f"{SHARES}, d as (select a.source as s, a.target as t, a.share - b.share as f from shares a join shares b on a.source = b.target and a.target = b.source where a.source < a.target) ;; select case when f >= 0 then s else t end as source, case when f >= 0 then t else s end as target, abs(f) as flow from d"),
    "forward_parity": sql("", "symbol date:d expiry:d F:f", f"""{CHAIN}, n as (select *, strike + exp(0.065 :: double * (expiry - date) / 365.0 :: double) * (call - put) as f, row_number() over (partition by symbol, date, expiry order by abs(call - put), strike) as r from c2 where call > 0 and put > 0),
      u as (select distinct symbol, date, expiry from c2 where symbol = 'Z' and day(expiry) % 2 = 0) ;; select symbol, date, expiry, case when u.symbol is not null then 1007.0 :: double else f end as "F" from (select symbol, date, expiry, median(f) as f from n where r <= 3 group by symbol, date, expiry) full join u using (symbol, date, expiry)"""),
    "iv30_interp": sql("", "symbol date:d iv30:f atm_near:f atm_next:f near_days:i skew_near:f F_near:f n_expiries:i term_slope:f sigma_day_implied:f", """s as (select translate(o_orderstatus, 'OFP', 'ANR') as symbol, cast(o_orderdate as date) as date, o_orderkey % 90 + 3 as days, max(0.1 :: double + (o_orderkey % 37) / 100.0 :: double) as atm, max(o_orderkey % 11 / 100.0 :: double) as skew, max(o_orderkey % 17 + 100.0 :: double) as fwd from orders group by 1, 2, 3),
      g as (select symbol, date, max(row(days, atm)) filter (days <= 30) as lo, min(row(days, atm)) filter (days >= 30) as hi, min(row(days, atm, skew, fwd)) as near, count(*) as n, list_sort(list(row(days, atm)))[2][2] as nxt from s group by symbol, date),
      i as (select *, case when lo is null then hi[2] when hi is null or lo[1] = hi[1] then lo[2] else sqrt((lo[2] * lo[2] * lo[1] + (hi[2] * hi[2] * hi[1] - lo[2] * lo[2] * lo[1]) * (30 - lo[1]) / (hi[1] - lo[1])) / 30) end as iv from g) ;;
      select symbol, date, iv as iv30, near[2] as atm_near, nxt as atm_next, near[1] as near_days, near[3] as skew_near, near[4] as "F_near", n as n_expiries, nxt - near[2] as term_slope, 100 * iv / sqrt(252) as sigma_day_implied from i"""),
    "garch_filter": "with recursive " + sql("bars", "symbol d:d h:f", f"""{RV}, x as (select symbol, d, ret / 100 as r, row_number() over (partition by symbol order by d) as t from rv),
      rec as (select symbol, 0 :: bigint as t, 1.0 :: double as h union all select rec.symbol, x.t, 0.05 :: double + 0.1 :: double * power(x.r, 2) + 0.85 :: double * rec.h from rec join x on x.symbol = rec.symbol and x.t = rec.t + 1) ;; select x.symbol, x.d, rec.h from rec join x using (symbol, t)""").removeprefix("with ").replace("rec as (select symbol, 0 :: bigint as t, 1.0 :: double as h union", "rec as (select distinct symbol, 0 :: bigint as t, 1.0 :: double as h from x union"),
}
ORACLE["vrp_summary"] = sql("bars", "symbol vrp:f positive:f ratio:f corr:f n:i", RV + ", " + ORACLE["iv30_interp"].removeprefix("with ").split("\nselect ")[0].rstrip() + """ ;; select symbol, avg(iv * 100 - sqrt(rv)) as vrp, avg((iv * 100 > sqrt(rv)) :: integer) as positive, median(iv * 100 / sqrt(rv)) as ratio, corr(iv * 100, sqrt(rv)) as corr, count(*) as n from rv join (select symbol, date as d, iv from i) i using (symbol, d) group by symbol""")
