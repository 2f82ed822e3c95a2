"""Small helpers of the subpackage, and the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import released, shared_dir, written

__all__ = ["Scratch", "crc_fold", "released", "shared_dir", "table", "written"]


class Scratch:
    """Tables written on the way to a result; those that the result does not read are deleted when it is ready."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(written(df, label))
        return self.tables[-1]

    def release(self, *keep: DataFrame) -> None:
        released(*[t for t in self.tables if not any(t is k for k in keep)])
        self.tables = list(keep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
