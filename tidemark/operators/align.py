"""Alignment of dated rows to a trading calendar: as-of, reaction day, intervals, fan-out, event windows.

A calendar (d, seq) is expanded to one row for each calendar day, with the trading day before and
after it. Its size is the number of days, not of rows, so every as-of is an equality join on a
day, which Spark broadcasts by its measured size; no range or window over the facts is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(days: DataFrame) -> DataFrame:
    """(d, seq): the distinct days, numbered from 1. A row for each trading day, whatever the number of facts."""
    return days.select("d").distinct().withColumn("seq", F.row_number().over(Window.orderBy("d")).cast("long"))


def day_map(cal: DataFrame, beyond: int = 400) -> DataFrame:
    """(day, prev_d, prev_seq, next_d, next_seq) for every day from the first trading day to `beyond` days after the last.

    next_* is null after the last trading day.
    """
    w = Window.orderBy("d")
    spans = cal.select("d", "seq", F.lead("d").over(w).alias("nd"))
    days = spans.select("d", "seq", "nd", F.explode(F.sequence("d", F.coalesce(F.date_sub("nd", 1), F.date_add("d", beyond)))).alias("day"))
    trading = F.col("day") == F.col("d")
    return days.select("day", F.col("d").alias("prev_d"), F.col("seq").alias("prev_seq"), F.when(trading, F.col("d")).otherwise(F.col("nd")).alias("next_d"), F.when(trading, F.col("seq")).when(F.col("nd").isNotNull(), F.col("seq") + 1).alias("next_seq"))


def asof_backward(rows: DataFrame, cal: DataFrame, on: str = "d") -> DataFrame:
    """Adds row_d and row_seq, the last trading day up to `on`; rows before the first, or without a day, are dropped. Rows after the last, however late, get the last."""
    m = day_map(cal, beyond=0).select(F.col("day").alias("_day"), F.col("prev_d").alias("row_d"), F.col("prev_seq").alias("row_seq"))
    last = cal.agg(F.max("d")).scalar()
    return rows.withColumn("_day", F.when(F.col(on).isNotNull(), F.least(on, last))).join(m, "_day").drop("_day")


def reaction_day(rows: DataFrame, cal: DataFrame, on: str = "d", after_close: str = "after_close") -> DataFrame:
    """Adds react_d: the same day, the next if after the close on a trading day, the first trading day otherwise.

    Rows whose reaction day is past the end, or has no trading day before it, are dropped.
    """
    m = day_map(cal).select(F.col("day").alias(on), "prev_d", "next_seq")
    seq = F.when((F.col(on) == F.col("prev_d")) & F.col(after_close), F.col("next_seq") + 1).otherwise(F.col("next_seq"))
    placed = rows.join(m, on).withColumn("react_seq", seq).drop("prev_d", "next_seq").filter("react_seq > 1")
    return placed.join(cal.select(F.col("d").alias("react_d"), F.col("seq").alias("react_seq")), "react_seq")


def shifted(rows: DataFrame, order: str, value: str, by: list[str], out: str = "target") -> DataFrame:
    """The value known at a row, keyed by the next row's day."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.select(*by, F.lead(order).over(w).alias(order), F.col(value).alias(out)).filter(F.col(order).isNotNull())


def active_intervals(starts: DataFrame, ends: DataFrame, by: str, days: int = 15) -> DataFrame:
    """(by, start, end): from each start until the first end within `days` days, else `days` days on.

    The end search is an equality join on expanded days, `days + 1` rows for each start.
    """
    asked = starts.select(by, F.col("d").alias("start")).distinct().withColumn("day", F.explode(F.sequence("start", F.date_add("start", days))))
    found = asked.join(ends.select(by, F.col("d").alias("day"), F.lit(True).alias("hit")).distinct(), [by, "day"], "left")
    return found.groupBy(by, "start").agg(F.coalesce(F.min(F.when(F.col("hit"), F.col("day"))), F.date_add(F.col("start"), days)).alias("end"))


def interval_flags(intervals: DataFrame, cal: DataFrame, by: str) -> DataFrame:
    """(by, d) trading days within any interval."""
    return intervals.select(by, F.explode(F.sequence("start", "end")).alias("d")).distinct().join(cal.select("d"), "d", "left_semi").select(by, "d")


def filing_flags(results: DataFrame, intimations: DataFrame, transcripts: DataFrame, cal: DataFrame, by: str, days: int = 15) -> DataFrame:
    """(by, d, results_filing, call_upcoming, transcript_published) 1.0 or 0.0, of the trading days with any of the three.

    A filing counts on the last trading day up to its own; a call is upcoming from its intimation to the next results, at most `days` days.
    """
    on_days = lambda rows: asof_backward(rows.select(by, "d").distinct(), cal).select(by, F.col("row_d").alias("d")).distinct()
    placed = {"results_filing": on_days(results), "transcript_published": on_days(transcripts)}
    placed["call_upcoming"] = interval_flags(active_intervals(on_days(intimations), placed["results_filing"], by, days), cal, by)
    names = ("results_filing", "call_upcoming", "transcript_published")
    marks = None
    for n in names:
        one = placed[n].select(by, "d", *[F.lit(float(m == n)).alias(m) for m in names])
        marks = one if marks is None else marks.unionByName(one)
    return marks.groupBy(by, "d").agg(*[F.max(n).alias(n) for n in names])


def followed_within(rows: DataFrame, later: DataFrame, by: str, days: int = 15) -> DataFrame:
    """Rows that have a `later` row with the same key from their day to `days` days on."""
    near = later.select(by, F.explode(F.sequence(F.date_sub("d", days), "d")).alias("d")).distinct()
    return rows.join(near, [by, "d"], "left_semi")


def fan_out(calls: DataFrame, cal: DataFrame, by: str, horizon: int, order: list[str]) -> DataFrame:
    """Each call lives on its row and the next `horizon - 1` rows; of several on a row the last by `order` counts."""
    placed = asof_backward(calls, cal).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("seq", F.col("row_seq") + F.col("_k"))
    last = Window.partitionBy(by, "seq").orderBy(*[F.desc(c) for c in order])
    live = placed.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "d", "row_d", "row_seq")
    return live.join(cal, "seq").withColumn("days_since", F.col("_k").cast("long")).drop("_k")


def cluster_starts(days: DataFrame, by: str, gap: int = 5) -> DataFrame:
    """Days over `gap` days after the flagged day before, and each key's first."""
    w = Window.partitionBy(by).orderBy("d")
    return days.withColumn("before", F.lag("d").over(w)).filter(F.col("before").isNull() | (F.datediff("d", "before") > gap)).drop("before")


def event_path(events: DataFrame, values: DataFrame, value: str, before: int = 5, after: int = 20) -> DataFrame:
    """Mean and count of `value` by offset in rows from the events (columns seq)."""
    asked = events.select((F.col("seq")).alias("at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("seq", F.col("at") + F.col("offset"))
    return asked.join(values.select("seq", value), "seq").groupBy(F.col("offset").cast("long").alias("offset")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def close_shift(ts: Column, zone: str = "Asia/Kolkata", close: int = 15 * 60 + 30) -> Column:
    """The local calendar day of a UTC timestamp, the next day from the close on."""
    local = F.from_utc_timestamp(ts, zone)
    return F.date_add(F.to_date(local), F.when(F.hour(local) * 60 + F.minute(local) >= close, 1).otherwise(0))


def business_day_add(d: Column) -> Column:
    """The next weekday."""
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def window_mean(rows: DataFrame, by: str, value: str, h: int, out: str) -> DataFrame:
    """Mean over the next `h` rows; null unless all are there."""
    w = Window.partitionBy(by).orderBy("d").rowsBetween(1, h)
    return rows.withColumn(out, F.when(F.count(value).over(w) == h, F.avg(value).over(w)))
