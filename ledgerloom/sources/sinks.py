"""Sinks: Parquet by partition columns, JSON lines, one-row JSON, and keyed upserts into Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Parquet, overwritten; partition columns let later filters prune folders."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_filings(filings: DataFrame, folder: str) -> None:
    """Parsed filings as JSON, one folder for each ticker and year (ticker=.../fiscal_year=...), overwritten."""
    filings.repartition("ticker", "fiscal_year").write.mode("overwrite").partitionBy("ticker", "fiscal_year").json(folder)


def write_matrix(vectors: DataFrame, folder: str, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Vectors as NumPy files `part-<n>.npy`, one for each partition, in a folder that all machines see. Returns (file, pos, key) of all rows.

    Each file is a float32 matrix in the order of pos; the ids go beside the files as a table, never by position alone.
    """
    import os

    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    os.makedirs(folder, exist_ok=True)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        rows = pd.concat(parts)
        name = f"part-{TaskContext.get().partitionId():05d}.npy"
        with open(f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            np.save(f, np.stack(rows["v"].to_numpy()).astype(np.float32))
        os.replace(f.name, f"{folder}/{name}")  # an attempt that is run again replaces the file whole
        yield pd.DataFrame({"file": name, "pos": np.arange(len(rows)), "key": rows["key"].to_numpy()})

    out = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v is not null").mapInPandas(run, f"file string, pos bigint, key {kind}").withColumnRenamed("key", key)
    out.write.mode("overwrite").parquet(f"{folder}/ids")
    return vectors.sparkSession.read.parquet(f"{folder}/ids")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by `order`; rows that tie fall by their content, so the result is stable. Keys that are null go."""
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc_nulls_last(o) for o in order), content))
    return df.where(F.col(key).isNotNull()).withColumn("__n", rank).where("__n = 1").drop("__n")


def merged(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows and those existing ones whose key does not come in."""
    return incoming.unionByName(existing.join(incoming.select(key), key, "left_anti"), allowMissingColumns=True)


class Table:
    """A Parquet table of versions: each write makes a new folder and then moves the pointer, so readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        fs, p = self._fs()
        if not fs.exists(p(self.path)):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(p(self.path)) if s.getPath().getName().startswith("v-") and fs.exists(p(f"{self.path}/{s.getPath().getName()}/_SUCCESS")))
        return f"{self.path}/{names[-1]}" if names else None

    def exists(self) -> bool:
        return self.current() is not None

    def read(self) -> DataFrame:
        at = self.current()
        if at is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(at)

    def _write(self, df: DataFrame) -> None:
        last = self.current()
        number = int(last.rsplit("/v-", 1)[1].split("-")[0]) + 1 if last else 0
        df.write.parquet(f"{self.path}/v-{number:012d}-{uuid.uuid4().hex[:8]}")

    def create(self, df: DataFrame, recreate: bool = False) -> None:
        """Writes the first version; does nothing if there is one, unless `recreate`."""
        if recreate or not self.exists():
            self._write(df)

    def upsert(self, df: DataFrame) -> None:
        """Rows of `df` replace those with the same key."""
        self._write(merged(self.read(), df, self.key) if self.exists() else df)

    def info(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("points"), F.count_distinct(self.key).alias("keys"))
