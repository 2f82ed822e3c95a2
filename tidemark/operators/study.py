"""Row rules, designs and reports of the event study and of the classifier runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as g

from . import daily, evaluate


def symbol_or_isin(rows: DataFrame, value: str) -> DataFrame:
    return rows.filter((F.col("symbol") == value) | (F.col("isin") == value))


def long_texts(rows: DataFrame, title: int = 15, text: int = 40) -> DataFrame:
    """Relevant rows whose normalised title and whose text are longer than these; nulls are short."""
    return rows.filter((F.col("relevance") > 0) & (F.length(daily.title_norm(F.col("title"))) > title) & (F.length("text") > text))


def filing_text(headline: Column, summary: Column, least: int = 25) -> Column:
    """The summary, after the headline if that is longer than `least`."""
    return F.when(F.length(headline) > least, F.concat(headline, F.lit(". "), F.coalesce(summary, F.lit("")))).otherwise(summary)


def reaction_valid(d: Column, after_close: Column) -> Column:
    """No weekend day, and not after the close of a Friday or of a weekend day."""
    return (F.weekday(d) < 5) & ~(after_close & F.weekday(d).isin(4, 5, 6))


def clipped(p: Column, edge: float = 1e-4) -> Column:
    return F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))


def transcript_filings(filings: DataFrame) -> DataFrame:
    """Filings that are call transcripts and have a path: the earliest of each (symbol, path). Takes symbol, d, id, sub, headline, path."""
    own = filings.filter(g.is_transcript(F.col("sub"), F.col("headline")) & F.col("path").isNotNull())
    return daily.first_of(own.select("symbol", "path", "d", "id"), ["symbol", "path"], ["d", "id"])


def call_universe(transcripts: DataFrame, prices: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(symbol): those asked for, or all, that have transcripts and prices."""
    names = transcripts.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_semi")
    return names.filter(F.col("symbol").isin(wanted)) if wanted else names


def design(rows: DataFrame, groups: list[str], symbols: list[str], special: str = "results") -> DataFrame:
    """One column for each group and symbol, the special group's effect by symbol, the log count, and the negative score of special rows.

    Categories are the given lists, fixed for all data, so a part of the rows gives the same columns. Takes group, symbol, n_filings, negative.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    is_special = F.col("group") == special
    out = {f"g_{x}": flag(F.col("group") == x) for x in groups} | {f"c_{x}": flag(F.col("symbol") == x) for x in symbols}
    out |= {f"special_{x}": flag(is_special & (F.col("symbol") == x)) for x in symbols}
    return rows.withColumns(out | {"ln_count": F.coalesce(F.ln("n_filings"), F.lit(0.0)), "negative_special": F.coalesce(F.col("negative") * flag(is_special), F.lit(0.0))})


def over_seeds(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation, first (by seed) and number of runs; one run has no deviation."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min_by(value, "seed").alias("first"), F.count(F.lit(1)).alias("runs"))


def mean_squared_error(rows: DataFrame, y: str, predicted: list[str], by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.pow(F.col(y) - F.col(p), 2)).alias(f"mse_{p}") for p in predicted])


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, equal ones once; columns meet by name."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    """Whether no key stands in both; null keys are keys."""
    same = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    return a.alias("a").join(b.alias("b"), same, "left_semi").isEmpty()


def probability_scores(rows: DataFrame, p: str, y: str, by: str) -> DataFrame:
    """Brier score, log loss (clipped), skill against the base rate, and area under the curve."""
    c = clipped(F.col(p))
    base = F.avg(y)
    sums = rows.groupBy(by).agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(F.when(F.col(y) == 1, -F.ln(c)).otherwise(-F.ln(1 - c))).alias("log_loss"), (base * (1 - base)).alias("_base"), F.count(F.lit(1)).alias("n")
    )
    out = sums.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("_base"))).drop("_base")
    return out.join(evaluate.auc(rows, p, y, by).select(by, "auc"), by)


def changes(rows: DataFrame, loss: str, base: str, by: list[str]) -> DataFrame:
    """Mean losses of subsets and the change in per cent against the base."""
    g_ = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(base).alias("base"))
    return g_.withColumn("change", 100 * (F.try_divide(F.col("loss"), F.col("base")) - 1))


def class_summary(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, macro F1 and sign flips (one of the classes 0 and 1 told for the other) in one row."""
    one = rows.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.count_if(((F.col(y) == 0) & (F.col(p) == 1)) | ((F.col(y) == 1) & (F.col(p) == 0))).alias("flips"), F.count(F.lit(1)).alias("n"))
    macro = evaluate.class_scores(rows, y, p).agg(F.avg("f1").alias("macro_f1"))
    return one.withColumn("_k", F.lit(1)).join(macro.withColumn("_k", F.lit(1)), "_k").drop("_k")


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b, p): exact two-sided p of two boolean columns that say which of two classifiers is right."""
    counts = rows.agg(F.count_if(F.col(a) & ~F.col(b)).cast("double").alias("x"), F.count_if(~F.col(a) & F.col(b)).cast("double").alias("y"))
    n, k = F.col("x") + F.col("y"), F.least("x", "y")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))  # the log of a binomial term, and the sum of those before it
    step = lambda acc, i: F.struct((acc["term"] + F.ln((n - i) / (i + 1))).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step)["sum"]
    return counts.select(F.col("x").cast("long").alias("only_a"), F.col("y").cast("long").alias("only_b"), F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0).alias("p"))


def bucket_means(rows: DataFrame, x: str, y: str, cuts: list[float]) -> DataFrame:
    """Mean and standard error of y by bucket of x, buckets (cuts[i], cuts[i + 1]]; values outside have none."""
    bucket = F.coalesce(*[F.when((F.col(x) > a) & (F.col(x) <= b), F.lit(i)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
    return rows.withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"))


def claims(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(claim, value, wanted, tolerance, holds) of (claim, value) and (claim, wanted, tolerance); a claim without a value does not hold."""
    j = expected.join(found.select("claim", "value"), "claim", "left")
    return j.select("claim", "value", "wanted", "tolerance", F.coalesce(F.abs(F.col("value") - F.col("wanted")) <= F.col("tolerance"), F.lit(False)).alias("holds"))


def exit_code(checked: DataFrame) -> int:
    """0 if all claims hold, else 1."""
    return int(not checked.filter("not holds").isEmpty())


def event_day_spillover(values: DataFrame, events: DataFrame, value: str, least: int = 5) -> DataFrame:
    """(reporter, affected, own, n_days, mean_on, mean_other, excess, t, ratio): what a name's `value` is on another's event days, against days without any event.

    Takes (name, d, value) and (name, d). A name's own event days are left out where another reports; pairs with fewer than `least` days are too. t is Welch's, ratio the exponential of
    the excess. Days are met by equality, so each event day costs a row for each name.
    """
    days = events.select("name", "d").distinct()
    known = values.select("name", "d", F.col(value).cast("double").alias("x")).dropna()
    other = known.join(days.select("d").distinct(), "d", "left_anti").groupBy(F.col("name").alias("affected")).agg(F.avg("x").alias("mean_other"), F.var_samp("x").alias("v0"), F.count("x").alias("n0"))
    own = days.select(F.col("name").alias("affected"), "d", F.lit(True).alias("busy"))
    met = known.withColumnRenamed("name", "affected").join(days.withColumnRenamed("name", "reporter"), "d").join(own, ["affected", "d"], "left")
    met = met.filter((F.col("reporter") == F.col("affected")) | F.col("busy").isNull())
    on = met.groupBy("reporter", "affected").agg(F.count("x").alias("n_days"), F.avg("x").alias("mean_on"), F.var_samp("x").alias("v1")).filter(F.col("n_days") >= least)
    excess = F.col("mean_on") - F.col("mean_other")
    error = F.sqrt(F.col("v1") / F.col("n_days") + F.col("v0") / F.col("n0"))
    return on.join(other, "affected").select("reporter", "affected", (F.col("reporter") == F.col("affected")).alias("own"), "n_days", "mean_on", "mean_other", excess.alias("excess"), F.try_divide(excess, error).alias("t"), F.exp(excess).alias("ratio"))
