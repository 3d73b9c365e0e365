"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process wrote and nobody has removed yet.
_MADE: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes all tables that `written` made, once the results that read them are out; how many. Call it when a query has ended."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    n = len(_MADE)
    while _MADE:
        path = hadoop(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _MADE and spark is not None:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def shared_folder(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir; only where that is unset and the master is local, a temporary one of this machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"ledgerloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder: columnar, so later reads prune columns and push filters down."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
