"""Order-dependent selection: events that keep their distance, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_apart(rows: DataFrame, by: str, days: int = 20, known: DataFrame | None = None) -> DataFrame:
    """Rows (by, d, path) in order of day and path that are not within 0 to `days` days after a kept one; known events suppress too, but are not returned.

    A fold over each key's ordered rows, in the JVM: what is kept depends on what was kept before. Later known events do not suppress.
    """
    row = F.struct("d", F.lit(1).alias("own"), "path")
    all_ = rows.select(by, row.alias("r"))
    if known is not None:
        all_ = all_.unionByName(known.select(by, F.struct("d", F.lit(0).alias("own"), F.lit("").alias("path")).alias("r")))
    kind = "struct<last:date,kept:array<struct<d:date,path:string>>>"
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<struct<d:date,path:string>>").alias("kept"))

    def step(acc, x):
        near = F.coalesce(F.datediff(x["d"], acc["last"]) <= days, F.lit(False))
        new = (x["own"] == 0) | ~near
        kept = F.when((x["own"] == 1) & ~near, F.concat(acc["kept"], F.array(F.struct(x["d"].alias("d"), x["path"].alias("path"))))).otherwise(acc["kept"])
        return F.struct(F.when(new, x["d"]).otherwise(acc["last"]).alias("last"), kept.alias("kept")).cast(kind)

    g = all_.groupBy(by).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return g.select(by, F.explode(F.aggregate("rows", start.cast(kind), step)["kept"]).alias("_x")).select(by, "_x.d", "_x.path")


def pending(rows: DataFrame, done: DataFrame, key: str, model: str) -> DataFrame:
    """Rows whose key has no result of this model yet."""
    return rows.join(done.filter(F.col("model") == model).select(key), key, "left_anti")
