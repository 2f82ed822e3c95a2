"""Queries on regressions, bootstraps, the live tracker, entities and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import entity
from tidemark.functions import numeric as nm
from tidemark.functions import signals as g
from tidemark.operators import bars, calls, graph, inference, options, tracker, walk
from tidemark.operators import evaluate as ev
from tidemark.sources import views as v

from .networks import BOTH, EDGES, _edges, _small
from .scores import FC, QL, _called, _forecasts
from .texts import _headlines
from .tidy import sql, tidy


def _logs(spark, sf):
    return bars.har(_forecasts(spark, sf)).withColumn("y", F.ln(F.col("rv_target"))).select("symbol", "d", "y", "lrv_d", "lrv_w", "lrv_m")


def hac_regression(spark, sf):
    return tidy(inference.regression(_logs(spark, sf), "symbol", "y", ["lrv_d", "lrv_w", "lrv_m"], 5))


def hc3_regression(spark, sf):
    return tidy(inference.regression(_logs(spark, sf), "symbol", "y", ["lrv_d", "lrv_w", "lrv_m"]))


def panel_fixed_effects(spark, sf):
    return tidy(inference.fixed_effects(_logs(spark, sf), "symbol", "y", ["lrv_d", "lrv_w", "lrv_m"]))


def _losses(spark, sf):
    f = _forecasts(spark, sf)
    return f.select("symbol", "d", *[ev.qlike(F.col("rv"), F.col(m)).alias(m) for m in ("f1", "f2")])


def contrast_table(spark, sf):
    return tidy(inference.contrasts(_losses(spark, sf), "symbol", [("f2", "f1")]))


def cluster_interval(spark, sf):
    return tidy(inference.cluster_bootstrap(_losses(spark, sf), "symbol", "f2", "f1"))


def confidence_set(spark, sf):
    return tidy(inference.confidence_sets(_losses(spark, sf), "symbol", ["f1", "f2"]))


def f1_interval(spark, sf):
    c = _called(spark, sf).select("y", F.col("p").alias("p1"), F.when(F.col("zp") > F.col("zn"), 0).otherwise(1).cast("long").alias("p2"))
    return tidy(inference.paired_f1(c.groupBy("y", "p1", "p2").agg(F.count(F.lit(1)).alias("n"))))


def garch_walk(spark, sf):
    r = bars.realised(v.bars(spark, sf)).select("symbol", "d", (F.col("ret") / 100).alias("ret"))
    return tidy(walk.garch(r, "symbol"))


def live_tracker(spark, sf):
    return tidy(tracker.tracked(_forecasts(spark, sf), "symbol", ["f1", "f2"], "1999-01-01"))


def live_summary(spark, sf):
    return tidy(tracker.summary(tracker.tracked(_forecasts(spark, sf), "symbol", ["f1", "f2"], "1999-01-01"), "symbol", ["f1", "f2"], "f1"))


#: Names that turn the invented titles into headlines about companies.
NAMED = ("TCS, Infosys, Wipro", "Infosys", "HCLTech drags, Sensex", "Tech Mahindra and TCS", "plain", "HCL Infosystems")


def _about(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMED)), (F.floor(F.col("doc_id") / 3) % len(NAMED) + 1).cast("int"))
    return _headlines(spark, sf).select("doc_id", F.concat(name, F.lit(" "), "title").alias("title"), F.lit("about infosys and tcs").alias("description"))


def entity_roles(spark, sf):
    return tidy(entity.analysed(_about(spark, sf), "TCS").select("doc_id", "entity.*"))


def marked_inputs(spark, sf):
    return tidy(_about(spark, sf).select("doc_id", entity.marked(F.col("title"), "INFY").alias("marked")))


def transcript_turns(spark, sf):
    c = v.read(spark, sf, "conversations").withColumn("who", F.when(F.col("role") == "user", "Amit Shah").when(F.col("role") == "assistant", "Raj Rao").otherwise("Moderator"))
    line = F.concat("who", F.lit("\n"), F.when(F.col("role") == "system", "The next question is from the line of Amit Shah. ").otherwise(""), F.regexp_replace("text", r"\s+", " "))
    t = c.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))["x"], "\n").alias("text"))
    return tidy(calls.parsed(t).groupBy("path", "role", "section").agg(F.count(F.lit(1)).alias("n")))


def focus_paragraphs(spark, sf):
    d = v.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("Stocks in focus. Infosys : "), F.col("text"), F.lit(". Wipro : other words here.")).alias("news"))
    return tidy(entity.focus(d, "INFY").select("doc_id", "focus_text", "focus_how"))


def call_inputs(spark, sf):
    c = v.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.col("text"), F.lit(" TCS may face risks but Infosys gains")).alias("sentence"), F.lit("analyst question").alias("context"))
    return tidy(calls.model_input(c, "TCS", "tcs").select("conv_id", "turn", "text_a", "text_b"))


def eigenvector(spark, sf):
    return tidy(spark.createDataFrame(list(nm.eigenvector(*_small(spark, sf)).items()), "name string, eigenvector double"))


def weighted_clustering(spark, sf):
    return tidy(graph.weighted_clustering(_edges(spark, sf)))


def _implied(spark, sf):
    o = v.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.avg(F.col("o_orderkey") % 37) / 10 + 1).alias("implied"))
    return _forecasts(spark, sf).join(o, "d")


def implied_regressions(spark, sf):
    x = _implied(spark, sf).select("symbol", "d", F.ln("rv").alias("y"), F.ln("implied").alias("implied"), F.ln("f2").alias("model"))
    out = inference.regression(x, "symbol", "y", ["implied"], 5).withColumn("set", F.lit("implied"))
    for name, features in (("model", ["model"]), ("both", ["implied", "model"])):
        out = out.unionByName(inference.regression(x, "symbol", "y", features, 5).withColumn("set", F.lit(name)))
    return tidy(out)


def implied_ladder(spark, sf):
    x = _implied(spark, sf).withColumn("u", F.ln(F.col("rv_target") / F.col("f2"))).withColumn("li", F.ln("implied")).withColumn("lf", F.ln("f1"))
    a, b = (walk.ols(x.select("symbol", "d", "u", "f2", *f), "symbol", "u", f, "f2").select("symbol", "d", F.col("forecast").alias(n)) for n, f in (("base", ["lf"]), ("with_iv", ["lf", "li"])))
    j = x.select("symbol", "d", "rv_target").join(a, ["symbol", "d"]).join(b, ["symbol", "d"]).filter("rv_target > 0")
    losses = j.select("symbol", "d", *[ev.qlike(F.col("rv_target"), F.col(m)).alias(m) for m in ("base", "with_iv")])
    return tidy(inference.contrasts(losses, "symbol", [("with_iv", "base")]))


def file_urls(spark, sf):
    return tidy(v.read(spark, sf, "orders").select(F.date_add(F.to_date("o_orderdate"), 9500).alias("d")).distinct().select("d", options.file_url("base", F.col("d")).alias("url")))


def lead_texts(spark, sf):
    return tidy(v.read(spark, sf, "documents").select("doc_id", g.lead_text(F.col("text")).alias("lead")))


QUERIES = {f.__name__: f for f in (hac_regression, hc3_regression, panel_fixed_effects, contrast_table, cluster_interval, confidence_set, f1_interval, garch_walk, live_tracker, live_summary, entity_roles, marked_inputs, transcript_turns, lead_texts, focus_paragraphs, call_inputs, eigenvector, weighted_clustering, implied_regressions, implied_ladder, file_urls)}
TRACK = FC + """, tr0 as (select symbol, lead(d) over w as nd, d as d0, lead(rv) over w as realised, f1, f2 from fc window w as (partition by symbol order by d)),
tr as (select symbol, coalesce(nd, cast(d0 + case isodow(d0) when 5 then 3 when 6 then 2 else 1 end as date)) as d, realised, f1, f2, nd is null as pending from tr0),
tracked as (select *, case when d >= date '1999-01-01' then 'test' else 'validation' end as period from tr)"""
ORACLE = {
    "weighted_clustering": sql("mentions", "name clustering:f", f"""{EDGES}, {BOTH}, u as (select source, target, weight / (select max(weight) :: double from edges) as w from edges),
      t as (select a.source as a, a.target as b, b.target as c, cbrt(a.w * b.w * c.w) as x from u a join u b on a.target = b.source join u c on c.source = a.source and c.target = b.target), per as (select name, sum(x) as x from (select unnest([a, b, c]) as name, x from t) group by name),
      deg as (select source as name, count(*) as k from two group by source) ;; select name, coalesce(2 * x / nullif(k * (k - 1), 0), 0) as clustering from deg left join per using (name)"""),
    "live_tracker": sql("bars", "symbol d:d realised:f f1:f f2:f pending period", f"{TRACK} ;; select * from tracked"),
    "live_summary": sql("bars", "symbol period model n:i qlike:f change:f", f"""{TRACK}, l as (select symbol, period, 'f1' as model, realised as rv, f1 as f, f1 as b from tracked where not pending union all select symbol, period, 'f2', realised, f2, f1 from tracked where not pending) ;;
      select symbol, period, model, count(*) as n, avg{QL('f')} as qlike, 100 * (avg{QL('f')} / avg{QL('b')} - 1) as change from l where rv > 0 and f > 0 group by symbol, period, model having count(*) >= 10"""),
    "file_urls": sql("", "d:d url", "select d, case when d >= date '2024-07-08' then 'base/BhavCopy_NSE_FO_0_0_0_' || strftime(d, '%Y%m%d') || '_F_0000.csv.zip' else 'base/' || strftime(d, '%Y') || '/' || upper(strftime(d, '%b')) || '/fo' || upper(strftime(d, '%d%b%Y')) || 'bhav.csv.zip' end as url from (select distinct cast(cast(o_orderdate as date) + 9500 as date) as d from orders)"),
    "lead_texts": sql("", "doc_id lead", r"""x as (select doc_id, text, substr(text, 1, 600) as head, regexp_extract(substr(text, 1, 600), '(?s)^(.*[.?!]) ', 1) as cut from documents) ;; select doc_id, case when length(text) > 600 and length(cut) > 240 then cut else head end as lead from x"""),
}
