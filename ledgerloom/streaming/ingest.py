"""Streams: chunks that arrive in files upserted into a table, and windowed counts with late rows (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.sources.sinks import Table, latest


def file_stream(spark: SparkSession, folder: str, schema: StructType, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder (or one file) as a stream; `files` bounds a batch."""
    r = spark.readStream.schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(path):
        folder, r = str(path.getParent()), r.option("pathGlobFilter", path.getName())
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(folder)


def upsert_stream(stream: DataFrame, table: Table, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Each batch's latest row per key goes into the table. A batch run again after a failure writes the same rows, so the result is the same."""

    def batch(df: DataFrame, _: int) -> None:
        rows = latest(df, table.key, order)
        if not rows.isEmpty():
            table.upsert(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total) by tumbling windows of event time; rows later than `late` behind the newest are dropped by the watermark, and state with them."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, by, n) by session windows."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
