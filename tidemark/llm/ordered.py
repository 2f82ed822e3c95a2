"""Places of rows in a total order, without a window that would put all rows, or a hot key's, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def numbered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """`df` with `at`, the place of each row in `order` from 0; where rows tie in all of it, any of them comes first.

    The rows are dealt by ranges, sorted within each and written; a row's place is its place within its range plus the
    rows of the ranges before. One number for each range reaches the driver. An empty table gives no rows. `released` drops the table when nothing reads the result any more.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_within": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), label)
    before, starts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        starts.append((r["_range"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    out = dealt.join(F.broadcast(start), "_range").withColumn("at", F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")
    out.written_to = dealt.written_to
    return out
