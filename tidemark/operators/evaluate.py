"""Scores and tests of forecasts and classifiers, as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normal


def softmax(zs: list[Column], temperature: float = 1.0) -> list[Column]:
    """Probabilities, with the greatest logit subtracted."""
    top = F.greatest(*zs)
    e = [F.exp((z - top) / temperature) for z in zs]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def argmax(values: list[Column], names: list) -> Column:
    """The name of the greatest value; ties go to the first."""
    top, out = F.greatest(*values), F.lit(names[-1])
    for v, n in reversed(list(zip(values, names, strict=True))[:-1]):
        out = F.when(v == top, F.lit(n)).otherwise(out)
    return out


def confusion(rows: DataFrame, y: str, p: str) -> DataFrame:
    return rows.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall and F1 of every class, from one pass over the pairs."""
    c = confusion(rows, y, p)
    none = F.lit(0).cast("long")
    own = c.select(F.col(y).alias("k"), F.col("n").alias("true"), none.alias("said"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(none).alias("hit"))
    both = own.unionByName(c.select(F.col(p).alias("k"), none.alias("true"), F.col("n").alias("said"), none.alias("hit")))
    g = both.groupBy("k").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    return g.select(F.col("k").alias("label"), F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "true"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("hit"), F.col("true") + F.col("said")), F.lit(0.0)).alias("f1"))


def calibration(rows: DataFrame, confidence: str, hit: str, bins: int = 5, low: float = 1 / 3) -> DataFrame:
    """Counts, mean confidence and accuracy of equal bins on [low, 1], the last one closed."""
    b = F.least(F.floor((F.col(confidence) - low) / ((1 - low) / bins)), F.lit(bins - 1)).cast("long")
    return rows.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(hit).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa from the contingency table."""
    c = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows_, cols = c.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x")), c.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = rows_.join(cols, "k").agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    seen = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0.0)).alias("same"))
    joined = seen.withColumn("_one", F.lit(1)).join(chance.withColumn("_one", F.lit(1)), "_one")  # one row each
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return joined.select(po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def qlike(rv: Column, forecast: Column) -> Column:
    x = rv / forecast
    return x - F.ln(x) - 1


def mincer_zarnowitz(rows: DataFrame, rv: str, forecast: str, by: str) -> DataFrame:
    """Error of the log, squared correlation and slope."""
    return rows.groupBy(by).agg(
        F.sqrt(F.avg(F.pow(F.ln(rv) - F.ln(forecast), 2))).alias("rmse_ln"), F.pow(F.corr(rv, forecast), 2).alias("r2"), F.regr_slope(rv, forecast).alias("slope"), F.avg(qlike(F.col(rv), F.col(forecast))).alias("qlike"), F.count(F.lit(1)).alias("n")
    )


def diebold_mariano(rows: DataFrame, diff: str, by: str, lags: int) -> DataFrame:
    """Statistic of a mean loss difference with Bartlett weights; 0 if the variance is not positive. One sort by key."""
    w = Window.partitionBy(by).orderBy("d")
    centred = rows.withColumn("_e", F.col(diff) - F.avg(diff).over(Window.partitionBy(by)))
    products = [F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"g{k}") for k in range(1, lags + 1)]
    lagged = centred.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    g = lagged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("g0"), *products)
    v = F.col("g0") / F.col("n") + sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / F.col("n") for k in range(1, lags + 1)), F.lit(0.0))
    return g.select(by, "n", "mean", F.when(v > 0, F.col("mean") / F.sqrt(v / F.col("n"))).otherwise(0.0).alias("dm"))


def average_ranks(rows: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """Ranks with ties at their mean; a null value has no rank. Values are combined first, so the window runs over distinct values."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = g.select("_by", "_value", (upto - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & (F.col(value) == F.col("_value")), "left").drop("_by", "_value")


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    r = average_ranks(average_ranks(rows, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def auc(rows: DataFrame, score: str, label: str, by: str) -> DataFrame:
    r = average_ranks(rows, score, by, "_r")
    n1, n0 = F.sum(label), F.sum(1 - F.col(label))
    return r.groupBy(by).agg(F.try_divide(F.sum(F.col("_r") * F.col(label)) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def welch(rows: DataFrame, value: str, flag: str, by: str) -> DataFrame:
    """Difference of means of flagged and other rows with Welch's error."""
    a, b = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    g = rows.groupBy(by).agg(F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"), F.count(a).alias("n1"), F.count(b).alias("n0"))
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return g.select(by, "n1", "n0", (F.col("m1") - F.col("m0")).alias("diff"), se.alias("se"), F.try_divide(F.col("m1") - F.col("m0"), se).alias("t"), F.exp(F.col("m1") - F.col("m0")).alias("ratio"))


def ladder(rows: DataFrame, by: str, rv: str, models: list[str], base: str, test_start: str, lags: int = 5, least: int = 20) -> DataFrame:
    """(by, period, model, n, qlike, change, dm, p) of forecasts before (validation) and from (test) a day on.

    Days count on which every model has a positive forecast and the variance is positive; periods with fewer than `least` of them are left out. `change` is in per cent of the base
    model's loss; dm and p (two-sided normal) compare with it and are null for itself.
    """
    good = [F.col(c) > 0 for c in (rv, *models)]
    both = rows.dropna(subset=[by, "d", rv, *models]).filter(_all(good))
    period = F.when(F.col("d") < F.lit(test_start).cast("date"), "validation").otherwise("test")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), qlike(F.col(rv), F.col(m)).alias("loss")) for m in models]))
    long_ = both.select(F.col(by).alias("_by"), period.alias("period"), "d", qlike(F.col(rv), F.col(base)).alias("_base"), each.alias("_e")).select("_by", "period", "d", "_base", "_e.*")
    long_ = long_.withColumns({"diff": F.col("loss") - F.col("_base"), "_key": F.struct("_by", "period", "model")})
    means = long_.groupBy("_key").agg(F.avg("loss").alias("qlike"), F.avg("_base").alias("_b"))
    out = diebold_mariano(long_, "diff", "_key", lags).join(means, "_key").filter(F.col("n") >= least)
    dm = F.when(F.col("_key.model") != base, F.col("dm"))
    return out.select(F.col("_key._by").alias(by), "_key.period", "_key.model", "n", "qlike", (100 * (F.col("qlike") / F.col("_b") - 1)).alias("change"), dm.alias("dm"), normal.two_sided(dm).alias("p"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def fit_temperature(rows: DataFrame, zs: list[str], y: str, low: float = 0.05, high: float = 50.0, exact: float = 1e-6, points: int = 16) -> float:
    """The temperature in [low, high] with the least mean negative log likelihood of class numbers `y` (from 0, in the order of `zs`).

    The likelihood has one minimum in the logarithm of the temperature. Each round takes it at `points + 1` temperatures in one aggregation and
    goes on between the neighbours of the best one, until they are `exact` apart; no logit leaves the executors. Rows with a
    null logit or class take no part. Raises a ValueError without any.
    """
    clean = rows.select(y, *zs).dropna()
    top, own = F.greatest(*zs) if len(zs) > 1 else F.col(zs[0]), F.element_at(F.array(*zs), (F.col(y) + 1).cast("int"))
    a, b = math.log(low), math.log(high)
    while b - a > exact:
        grid = [a + (b - a) * i / points for i in range(points + 1)]
        loss = lambda t: F.avg(F.ln(sum((F.exp((F.col(z) - top) / t) for z in zs[1:]), F.exp((F.col(zs[0]) - top) / t))) - (own - top) / t)
        got = clean.agg(*[loss(math.exp(g)).alias(f"l{i}") for i, g in enumerate(grid)]).first()
        if got[0] is None:
            raise ValueError("no row with logits and a class")
        best = min(range(points + 1), key=lambda i: got[i])
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, points)]
    return math.exp((a + b) / 2)


def masked(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row for every named mask that holds: overlapping subsets in one pass."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in masks.items()]), lambda m: m.isNotNull())
    return rows.withColumn("subset", F.explode(names))


def permuted(rows: DataFrame, columns: list[str], within: str, key: str, seed: int) -> DataFrame:
    """Placebo: the columns dealt anew within groups, by the order of a seeded md5 of the key. Rows without a group form one."""
    a = Window.partitionBy(within).orderBy(key)
    b = Window.partitionBy(within).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)
    own = rows.withColumn("_r", F.row_number().over(a)).drop(*columns)
    other = rows.select(F.col(within).alias("_g"), *columns, F.row_number().over(b).alias("_o"))
    return own.join(other, F.col(within).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_o"))).drop("_r", "_g", "_o")


def weighted_sample(rows: DataFrame, key: str, weight: str, stratum: str, n: int, seed: str = "s") -> DataFrame:
    """n rows of each stratum without replacement, with chances by weight: the least -ln(u) / w, u from md5 of the key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    w = Window.partitionBy(stratum).orderBy("_k", key)
    return rows.filter(F.col(weight) > 0).withColumn("_k", -F.ln(u) / F.col(weight)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_k", "_r")
