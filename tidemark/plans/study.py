"""Queries on event-study rules, designs, reports, latest forecasts and network summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import signals as g
from tidemark.operators import bars, evaluate, graph, study, walk
from tidemark.sources import views as v

from .daily import RV, world
from .networks import BOTH, EDGES, _edges
from .scores import CALLED, ONE, _called, _forecasts
from .tidy import sql, tidy

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CUTS = [-1, 0, 1, 3, 7, 1000]


def _filed(spark, sf):
    """Filings with an id of the company, a headline, a summary and a path; some without."""
    i = F.col("id")
    headline = F.when(i % 4 == 0, "Earnings Call Transcript").when(i % 4 == 1, "Transcript of the AGM results").when(i % 4 == 2, F.concat(F.lit("Outcome of the board meeting "), i.cast("string")))
    return v.filings(spark, sf).select("*", F.concat(F.lit("IN"), F.substring("symbol", 1, 3)).alias("isin"), headline.alias("headline"), F.when(i % 5 != 0, F.concat(F.lit("Summary of "), i.cast("string"))).alias("summary"), F.when(i % 7 != 0, F.concat(F.lit("p"), (i % 501).cast("string"))).alias("path"))


FILED = """filed as (select *, 'IN' || substr(symbol, 1, 3) as isin, case id % 4 when 0 then 'Earnings Call Transcript' when 1 then 'Transcript of the AGM results' when 2 then 'Outcome of the board meeting ' || id end as headline,
  case when id % 5 <> 0 then 'Summary of ' || id end as summary, case when id % 7 <> 0 then 'p' || (id % 501) end as path from filings)"""


def symbol_or_isin(spark, sf):
    f = _filed(spark, sf)
    return tidy(study.symbol_or_isin(f, "BUILDING").unionByName(study.symbol_or_isin(f, "INMAC")).select("id", "symbol", "isin"))


def long_texts(spark, sf):
    return tidy(study.long_texts(v.articles(spark, sf)).select("doc_id"))


def filing_text(spark, sf):
    return tidy(_filed(spark, sf).select("id", study.filing_text(F.col("headline"), F.col("summary")).alias("text")))


def reaction_valid(spark, sf):
    return tidy(v.filings(spark, sf).select("id", study.reaction_valid(F.col("d"), F.col("after_close")).alias("valid")))


def transcript_filings(spark, sf):
    return tidy(study.transcript_filings(_filed(spark, sf)))


def call_universe(spark, sf):
    prices = v.filings(spark, sf).filter("sub = 'P'").select("symbol")
    t = study.transcript_filings(_filed(spark, sf)).select("symbol")
    return tidy(study.call_universe(t, prices).withColumn("of", F.lit("all")).unionByName(study.call_universe(t, prices, ["BUILDING", "NONE"]).withColumn("of", F.lit("asked"))))


def study_design(spark, sf):
    f = v.filings(spark, sf).select("id", "group", "symbol", (F.col("id") % 9 + 1).alias("n_filings"), (F.col("id") % 10 / 10.0).alias("negative"))
    return tidy(study.design(f, PRIORITIES[:2], SEGMENTS[:2], special="1-URGENT").drop("group", "symbol", "n_filings", "negative").withColumnsRenamed({"g_1-URGENT": "g_1", "g_2-HIGH": "g_2"}))


def over_seeds(spark, sf):
    runs = v.read(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"))
    return tidy(study.over_seeds(runs, ["o_orderpriority", "o_orderstatus"], "score"))


def mean_squared_error(spark, sf):
    f = _forecasts(spark, sf).select("symbol", F.ln("rv").alias("u"), F.ln("f1").alias("b1"), F.ln("f2").alias("b2"))
    return tidy(study.mean_squared_error(f, "u", ["b1", "b2"], ["symbol"]))


def union_distinct(spark, sf):
    b = world(spark, sf)[0]
    return tidy(study.union_distinct([b.filter(F.col("symbol") == s).select("d") for s in "ANR"]))


def disjointness(spark, sf):
    a = v.articles(spark, sf).select("src", "d")
    early, late = a.filter("d < '1999-01-01'"), a.filter("d >= '1999-01-01'")
    return tidy(spark.createDataFrame([("d", study.disjoint(early, late, ["d"])), ("src", study.disjoint(early, late, ["src"]))], "key string, disjoint boolean"))


def _moves(spark, sf):
    """The chance of a large move by the share of the last variance, and whether it came."""
    f = _forecasts(spark, sf)
    return f.select("symbol", "d", (F.col("f1") / (F.col("f1") + F.col("f2"))).alias("p"), (F.col("rv") > F.col("f2")).cast("double").alias("y"))


def probability_scores(spark, sf):
    return tidy(study.probability_scores(_moves(spark, sf), "p", "y", "symbol"))


def loss_changes(spark, sf):
    f = _forecasts(spark, sf).select("symbol", F.year("d").cast("long").alias("year"), evaluate.qlike(F.col("rv"), F.col("f2")).alias("l2"), evaluate.qlike(F.col("rv"), F.col("f1")).alias("l1"))
    return tidy(study.changes(f, "l2", "l1", ["symbol", "year"]))


def class_summary(spark, sf):
    return tidy(study.class_summary(_called(spark, sf), "y", "p"))


def mcnemar_exact(spark, sf):
    c = _called(spark, sf).select((F.col("hit") == 1).alias("a"), (F.when(F.col("zp") > F.col("zn"), 0).otherwise(1) == F.col("y")).alias("b"))
    return tidy(study.mcnemar(c, "a", "b"))


def bucket_means(spark, sf):
    return tidy(study.bucket_means(v.articles(spark, sf).withColumn("x", (F.col("doc_id") % 40).cast("double")).withColumn("y", F.col("relevance") + F.col("doc_id") % 3), "x", "y", CUTS))


def claim_check(spark, sf):
    found = v.filings(spark, sf).groupBy(F.col("sub").alias("claim")).agg(F.count_if("after_close") / F.count(F.lit(1)))
    expected = spark.createDataFrame([("O", 0.33, 0.02), ("F", 0.9, 0.01), ("none", 1.0, 9.0)], "claim string, wanted double, tolerance double")
    return tidy(study.claims(found.toDF("claim", "value"), expected))


def _har(spark, sf):
    return bars.har(_forecasts(spark, sf)).withColumn("u", F.ln(F.col("rv_target") / F.col("f2")))


def latest_forecast(spark, sf):
    return tidy(walk.latest(_har(spark, sf), "symbol", "u", ["lrv_d"], "f2"))


def unit_effects(spark, sf):
    return tidy(walk.unit_effects(_har(spark, sf), "symbol", "u", ["lrv_m"]))


def graph_summary(spark, sf):
    return tidy(graph.summary(_edges(spark, sf), v.read(spark, sf, "part").select(F.col("p_brand").alias("name"))))


def graph_diameter(spark, sf):
    return tidy(graph.diameter(graph.comentions(v.mentions(spark, sf))))


def top_ties(spark, sf):
    return tidy(graph.top_ties(_edges(spark, sf)))


QUERIES = {f.__name__: f for f in (symbol_or_isin, long_texts, filing_text, reaction_valid, transcript_filings, call_universe, study_design, over_seeds, mean_squared_error, union_distinct, disjointness, probability_scores, loss_changes, class_summary, mcnemar_exact, bucket_means, claim_check, latest_forecast, unit_effects, graph_summary, graph_diameter, top_ties)}

FORE = """fore0 as (select symbol, d, rv, rv_target, lag(rv) over w as f1, case when count(rv) over w5 = 5 then avg(rv) over w5 end as m5 from rv window w as (partition by symbol order by d), w5 as (partition by symbol order by d rows 4 preceding)),
fore1 as (select *, lag(m5) over (partition by symbol order by d) as f2 from fore0),
fore as (select * from fore1 where f2 is not null and rv > 0 and f1 > 0)"""
_T = f"regexp_matches(headline, '(?i){g.TRANSCRIPT}')"
_C = f"regexp_matches(headline, '(?i){g.CALL}') and not regexp_matches(headline, '(?i){g.NOT_CALL}')"
TRANS = f"trans as (select symbol, path, arg_min(d, row(d, id)) as d, arg_min(id, row(d, id)) as id from filed where path is not null and (sub = 'Earnings Call Transcript' or ({_T} and {_C})) group by symbol, path)"
ORACLE = {
    "symbol_or_isin": sql("filings", "id symbol isin", f"{FILED} ;; select * from filed where symbol in ('BUILDING', 'MACHINERY')"),
    "long_texts": sql("articles", "doc_id", "select doc_id from articles where relevance > 0 and length(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) > 15 and length(text) > 40"),
    "filing_text": sql("filings", "id text", f"{FILED} ;; select id, case when length(headline) > 25 then headline || '. ' || coalesce(summary, '') else summary end as text from filed"),
    "reaction_valid": sql("filings", "id valid", "select id, isodow(d) < 6 and not (after_close and isodow(d) >= 5) as valid from filings"),
    "transcript_filings": sql("filings", "symbol path d:d id", f"{FILED}, {TRANS} ;; select * from trans"),
    "call_universe": sql("filings", "symbol of", f"{FILED}, {TRANS}, names as (select distinct symbol from trans where symbol in (select symbol from filings where sub = 'P')) ;; select symbol, 'all' as of from names union all select symbol, 'asked' from names where symbol = 'BUILDING'"),
    "study_design": sql("filings", "id g_1:f g_2:f c_AUTOMOBILE:f c_BUILDING:f special_AUTOMOBILE:f special_BUILDING:f ln_count:f negative_special:f", """select id, ("group" = '1-URGENT') :: int as g_1, ("group" = '2-HIGH') :: int as g_2, (symbol = 'AUTOMOBILE') :: int as c_AUTOMOBILE, (symbol = 'BUILDING') :: int as c_BUILDING,
      ("group" = '1-URGENT' and symbol = 'AUTOMOBILE') :: int as special_AUTOMOBILE, ("group" = '1-URGENT' and symbol = 'BUILDING') :: int as special_BUILDING, ln(id % 9 + 1) as ln_count, case when "group" = '1-URGENT' then id % 10 / 10.0 :: double else 0 end as negative_special from filings"""),
    "over_seeds": sql("", "o_orderpriority o_orderstatus mean:f sd:f first:f runs:i", "select o_orderpriority, o_orderstatus, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, arg_min(o_totalprice, o_orderkey) as first, count(*) as runs from orders group by all"),
    "mean_squared_error": sql("bars", "symbol n:i mse_b1:f mse_b2:f", f"{RV}, {FORE} ;; select symbol, count(*) as n, avg(power(ln(rv) - ln(f1), 2)) as mse_b1, avg(power(ln(rv) - ln(f2), 2)) as mse_b2 from fore group by symbol"),
    "union_distinct": sql("bars", "d:d", "select distinct d from bars where symbol in ('A', 'N', 'R')"),
    "disjointness": sql("articles", "key disjoint", "select 'd' as key, not exists (select d from articles where d < date '1999-01-01' intersect select d from articles where d >= date '1999-01-01') as disjoint union all select 'src', not exists (select src from articles where d < date '1999-01-01' intersect select src from articles where d >= date '1999-01-01')"),
    "probability_scores": sql("bars", "symbol brier:f log_loss:f n:i skill:f auc:f", f"""{RV}, {FORE}, m as (select symbol, f1 / (f1 + f2) as p, (rv > f2) :: int as y from fore), k as (select *, greatest(1e-4, least(1 - 1e-4, p)) as c, rank() over (partition by symbol order by p) + (count(*) over (partition by symbol, p) - 1) / 2.0 :: double as r from m) ;;
      select symbol, avg(power(p - y, 2)) as brier, avg(case when y = 1 then -ln(c) else -ln(1 - c) end) as log_loss, count(*) as n, 1 - avg(power(p - y, 2)) / (avg(y) * (1 - avg(y))) as skill, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) as auc from k group by symbol"""),
    "loss_changes": sql("bars", "symbol year:i n:i loss:f base:f change:f", f"{RV}, {FORE}, l as (select symbol, year(d) as year, rv / f2 - ln(rv / f2) - 1 as l2, rv / f1 - ln(rv / f1) - 1 as l1 from fore) ;; select symbol, year, count(*) as n, avg(l2) as loss, avg(l1) as base, 100 * (avg(l2) / avg(l1) - 1) as change from l group by symbol, year"),
    "class_summary": sql("logits", "accuracy:f flips:i n:i macro_f1:f", f"""{ONE}, {CALLED}, k as (select y as k from called union select p from called), f as (select k, 2.0 * (select count(*) from called where y = k and p = k) / ((select count(*) from called where y = k) + (select count(*) from called where p = k)) as f1 from k) ;;
      select avg((y = p) :: int) as accuracy, count(*) filter ((y = 0 and p = 1) or (y = 1 and p = 0)) as flips, count(*) as n, (select avg(f1) from f) as macro_f1 from called"""),
    "mcnemar_exact": sql("logits", "only_a:i only_b:i p:f", f"""{ONE}, {CALLED}, w as (select called.p = called.y as a, case when logits.zp > logits.zn then 0 else 1 end = called.y as b from called join logits using (id)), c as (select count(*) filter (a and not b) as x, count(*) filter (b and not a) as z from w) ;;
      select x as only_a, z as only_b, case when x + z = 0 then 1.0 :: double else least(1, 2 * (select sum(exp(lgamma(x + z + 1) - lgamma(i + 1) - lgamma(x + z - i + 1) - (x + z) * ln(2))) from (select unnest(range(0, least(x, z) + 1)) as i))) end as p from c"""),
    "bucket_means": sql("articles", "bucket:i n:i mean:f sem:f", "b as (select case when x <= 0 then 0 when x <= 1 then 1 when x <= 3 then 2 when x <= 7 then 3 else 4 end as bucket, y from (select doc_id % 40 as x, relevance + doc_id % 3 as y from articles)) ;; select bucket, count(y) as n, avg(y) as mean, stddev_samp(y) / sqrt(count(y)) as sem from b group by bucket"),
    "claim_check": sql("filings", "claim value:f wanted:f tolerance:f holds", "e as (select * from (values ('O', 0.33 :: double, 0.02 :: double), ('F', 0.9, 0.01), ('none', 1.0, 9.0)) t(claim, wanted, tolerance)), f as (select sub as claim, count(*) filter (after_close) / count(*) as value from filings group by sub) ;; select claim, value, wanted, tolerance, coalesce(abs(value - wanted) <= tolerance, false) as holds from e left join f using (claim)"),
    "latest_forecast": sql("bars", "symbol d:d u_hat:f forecast:f", f"""{RV}, {FORE}, h as (select symbol, d, ln(rv) as x, ln(rv_target / f2) as u, f2 from fore), k as (select symbol, count(*) as n, regr_slope(u, x) as b, regr_intercept(u, x) as a, regr_syy(u, x) as syy, regr_sxy(u, x) as sxy from h where u is not null group by symbol),
      last as (select symbol, max(d) as d, arg_max(x, d) as x, arg_max(f2, d) as f2 from h group by symbol) ;; select symbol, d, a + b * x as u_hat, f2 * exp(a + b * x + (syy - b * sxy) / (n - 2) / 2) as forecast from k join last using (symbol)"""),
    "unit_effects": sql("bars", "symbol feature coefficient:f", f"""{RV}, {FORE}, h as (select symbol, case when count(rv) over w = 22 then ln(avg(rv) over w) end as x, ln(rv_target / f2) as u from fore window w as (partition by symbol order by d rows 21 preceding)) ;; select symbol, 'lrv_m' as feature, regr_slope(u, x) * stddev_pop(x) as coefficient from h where x is not null and u is not null group by symbol"""),
    "graph_summary": sql("mentions", "nodes:i edges:i density:f isolates:i mean_degree:f mean_strength:f components:i giant:i", f"""{EDGES}, {BOTH}, names as (select distinct p_brand as name from part), d as (select name, count(source) as k, coalesce(sum(weight), 0) as s from names left join two on source = name group by name) ;;
      select count(*) as nodes, sum(k) / 2 as edges, sum(k) / (count(*) * (count(*) - 1)) as density, count(*) filter (k = 0) as isolates, avg(k) as mean_degree, avg(s) as mean_strength, count(*) filter (k = 0) + 1 as components, count(*) filter (k > 0) as giant from d"""),
    "top_ties": sql("mentions", "source target weight:i", f"{EDGES} ;; select * from edges order by weight desc, source, target limit 10"),
}
