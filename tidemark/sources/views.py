"""The driver's tables in the shapes that the operators take: bars, calendar, articles, filings, sentences, logits, mentions, chain.

Each view is a DataFrame function here and an equal SQL text in `SQL`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, o, h, l, c, v): weekday price bars with a range, from line items."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    t = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("d"), F.struct(*KEY).alias("k"), px.alias("px"), F.col("l_quantity").alias("q"))
    g = t.filter(F.weekday("d") < 5).groupBy("symbol", "d").agg(F.min_by("px", "k").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "k").alias("c"), F.sum("q").alias("v"))
    return g.filter("h > l")


def calendar(bars_: DataFrame, symbol: str = "A") -> DataFrame:
    """(d, seq): trading days of one symbol, numbered from 1. A few thousand rows whatever the number of bars."""
    return bars_.filter(F.col("symbol") == symbol).select("d").distinct().withColumn("seq", F.row_number().over(Window.orderBy("d")).cast("long"))


POSITIVE, NEGATIVE = ("the", "de", "die", "que"), ("of", "la", "der", "le")


def lexicon_score(text: Column, positive: tuple = POSITIVE, negative: tuple = NEGATIVE) -> Column:
    """(p - n) / (p + n) over the words of the lists; null without any."""
    words = F.split(F.lower(text), " ")
    p, n = (F.size(F.filter(words, _among(lst))) for lst in (positive, negative))
    return F.try_divide((p - n).cast("double"), (p + n).cast("double"))


def _among(words: tuple):
    return lambda w: w.isin(*words)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, d, title, text, src, s, relevance, is_focus, kind, s_focus) from documents.

    The title is the head of the text; s is scored on all of it. Every sixth article is a roundup with a score of its own paragraph.
    """
    title = F.substring("text", 1, 80)
    relevance = F.element_at(F.array(*map(F.lit, (1.0, 0.5, 0.2, 0.1, 0.0))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") * 7 % 2400).cast("int")).alias("d"), title.alias("title"), "text", F.col("source").alias("src"), lexicon_score(F.col("text")).alias("s"), relevance.alias("relevance"),
        (F.col("doc_id") % 6 == 0).alias("is_focus"), F.when(F.col("doc_id") % 7 == 0, "results").otherwise("other").alias("kind"), F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") % 13 - 6) / F.lit(6.0)).alias("s_focus"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, d, group, sub, after_close) from orders and customers."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("group"), F.col("o_orderstatus").alias("sub"), (F.col("o_orderkey") % 3 == 0).alias("after_close"), F.col("o_totalprice").alias("value")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, zp, zn, zu, y) from embeddings."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(F.get(e, i).cast("double") * 10).alias(n) for i, n in enumerate(("zp", "zn", "zu"))], (F.col("label") % 3).cast("long").alias("y"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, name): distinct brands of each order."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("item"), F.col("p_brand").alias("name")).distinct()


SQL = {
    "bars": """bars as (select symbol, d, first(px order by k1, k2, k3, k4, k5) as o, max(px) as h, min(px) as l, last(px order by k1, k2, k3, k4, k5) as c, sum(q) as v
      from (select l_returnflag as symbol, cast(l_shipdate as date) as d, l_extendedprice / l_quantity as px, l_quantity as q, l_orderkey as k1, l_linenumber as k2, l_partkey as k3, l_suppkey as k4, l_extendedprice as k5 from lineitem)
      where isodow(d) < 6 group by symbol, d having max(px) > min(px))""",
    "cal": "cal as (select d, row_number() over (order by d) as seq from (select distinct d from bars where symbol = 'A'))",
    "articles": """articles as (select doc_id, cast(date '1995-01-02' + cast(doc_id * 7 % 2400 as integer) as date) as d, substr(text, 1, 80) as title, text, source as src,
      case when p + n > 0 then cast(p - n as double) / (p + n) end as s, [1.0, 0.5, 0.2, 0.1, 0.0][doc_id % 5 + 1] :: double as relevance,
      doc_id % 6 = 0 as is_focus, case when doc_id % 7 = 0 then 'results' else 'other' end as kind, case when doc_id % 6 = 0 then (doc_id % 13 - 6) / 6.0 :: double end as s_focus
      from (select *, len(list_filter(string_split(lower(text), ' '), lambda w: w in ('the', 'de', 'die', 'que'))) as p,
        len(list_filter(string_split(lower(text), ' '), lambda w: w in ('of', 'la', 'der', 'le'))) as n from documents))""",
    "filings": """filings as (select o_orderkey as id, c_mktsegment as symbol, cast(o_orderdate as date) as d, o_orderpriority as "group", o_orderstatus as sub, o_orderkey % 3 = 0 as after_close, o_totalprice as value
      from orders join customer on o_custkey = c_custkey)""",
    "logits": "logits as (select vec_id as id, embedding[1] :: double * 10 as zp, embedding[2] :: double * 10 as zn, embedding[3] :: double * 10 as zu, label % 3 as y from embeddings)",
    "mentions": "mentions as (select distinct l_orderkey as item, p_brand as name from lineitem join part on l_partkey = p_partkey)",
}
