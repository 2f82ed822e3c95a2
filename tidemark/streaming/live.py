"""Incremental jobs: file streams that upsert prices, deduplicate headlines and publish, in available-now micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import daily


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Merged:
    """A table as a base and deltas. A batch writes its own rows only; reading puts base and deltas together.

    With `key` and `order` the row with the greatest `order` of each key counts; without, all rows do. After `fold` deltas a new base is written, and what
    the base before it replaced is deleted. A batch that runs again writes the same delta, and still finds the state before it; a write that
    fails leaves no mark, so it does not count.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, order: list[str] | None = None, fold: int = 16):
        self.spark, self.path, self.key, self.order, self.fold = spark, path.rstrip("/"), key, order, fold

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self) -> dict[str, list[int]]:
        """Numbers of the complete bases and deltas."""
        root, fs = self._fs()
        out: dict[str, list[int]] = {"base": [], "delta": []}
        for s in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, n = s.getPath().getName().partition("-")
            if kind in out and n.isdigit() and _exists(self.spark, f"{self.path}/{kind}-{n}/_SUCCESS"):
                out[kind].append(int(n))
        return {k: sorted(v) for k, v in out.items()}

    def read(self, before: int | None = None) -> DataFrame | None:
        """The state, or the one before a batch; None if there is none."""
        done = self._done()
        base = max((v for v in done["base"] if before is None or v < before), default=None)
        return self._state(base, [v for v in done["delta"] if (before is None or v < before) and (base is None or v > base)])

    def _state(self, base: int | None, deltas: list[int]) -> DataFrame | None:
        paths = ([f"{self.path}/base-{base}"] if base is not None else []) + [f"{self.path}/delta-{v}" for v in deltas]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return daily.latest(rows, self.key, self.order).select(rows.columns) if self.key and deltas else rows

    def add(self, df: DataFrame, version: int) -> None:
        """Adds the rows of one batch."""
        df.write.mode("overwrite").parquet(f"{self.path}/delta-{version}")
        done = self._done()
        base = max((v for v in done["base"] if v < version), default=None)
        since = [v for v in done["delta"] if v <= version and (base is None or v > base)]
        if len(since) >= self.fold:
            self._state(base, since).write.mode("overwrite").parquet(f"{self.path}/base-{version}")
            root, fs = self._fs()
            old = [f"base-{v}" for v in done["base"] if base is not None and v < base] + [f"delta-{v}" for v in done["delta"] if base is not None and v <= base]
            for name in old:  # the base before, and the deltas since, serve a batch that runs again
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def upsert(rows: DataFrame, target: str, checkpoint: str, key: list[str], order: list[str], fold: int = 16):
    """Keep-last upsert of a stream; a batch is combined by key before it is written, and late rows lose to newer ones on reading."""
    table = Merged(rows.sparkSession, target, key, order, fold)

    def batch(df: DataFrame, version: int) -> None:
        table.add(daily.latest(df, key, order).select(df.columns), version)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(rows: DataFrame, target: str, checkpoint: str, key: list[str], order: list[str], score: Callable[[DataFrame], DataFrame] = lambda d: d, fold: int = 16):
    """Rows whose key the table does not hold yet, each key once (the least by `order`), scored before they are added. Of the table only the keys are read."""
    table = Merged(rows.sparkSession, target, fold=fold)

    def batch(df: DataFrame, version: int) -> None:
        table.add(score(unknown(daily.first_of(df, key, order), table.read(version), key)), version)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unknown(rows: DataFrame, known: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows whose key is not among the known ones; a null in a key equals a null."""
    if known is None:
        return rows
    keys = known.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(keys, same, "left_anti")


def deduplicated(rows: DataFrame, time: str, key: list[str], late: str = "2 days") -> DataFrame:
    """A stream without repeats of a key within the watermark; the state ends with it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def publish(rows: DataFrame, target: str, checkpoint: str, build: Callable[[DataFrame], dict[str, DataFrame]]):
    """Small reports as JSON after every batch, see `written_reports`."""

    def batch(df: DataFrame, version: int) -> None:
        written_reports(build(df), target)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_reports(reports: dict[str, DataFrame], target: str) -> None:
    """Each report as JSON lines below `target`, in place of the one before."""
    for name, report in reports.items():
        report.coalesce(1).write.mode("overwrite").json(f"{target}/{name}")


def recent(rows: DataFrame, time: str, n: int = 60, days: int = 30) -> DataFrame:
    """The latest relevant headlines of the last days."""
    last = rows.agg(F.max(time).alias("last"))
    r = rows.filter("relevance > 0").join(F.broadcast(last), F.col(time) >= F.expr(f"last - interval {days} days")).drop("last")
    return r.orderBy(F.desc(time), "title").limit(n)
