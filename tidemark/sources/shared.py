"""Tables that several steps read, written once to the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, but only if all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return _own[key]


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: the lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    spark._jvm.System.gc()  # the step's shuffle files have no reader any more: Spark's cleaner drops what is unreachable
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
