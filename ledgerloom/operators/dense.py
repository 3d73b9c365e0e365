"""Exact dense search and checks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.persist import written


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(inner(v, v))


def _best(score: np.ndarray, ids: np.ndarray, k: int, digits: int) -> list[np.ndarray]:
    """Columns of the k best of each row, ties after rounding by id."""
    rounded = np.round(score, digits)
    if rounded.shape[1] > 4 * k:  # all that reach the k-th best value, then in order
        cut = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, rounded.shape[1] - k]
        return [(lambda c: c[np.lexsort((ids[c], -r[c]))][:k])(np.nonzero(r >= t)[0]) for r, t in zip(rounded, cut, strict=True)]
    return [np.lexsort((ids, -r))[:k] for r in rounded]


def search(corpus: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", qid: str = "qid", query_vector: str = "vector", block: int = 8192, digits: int = 9) -> DataFrame:
    """(qid, id, score, rank): each query's k best of the corpus by cosine; ties, after rounding to `digits`, by id.

    A stated query set against all rows, by matrix products over Arrow batches: queries go out in blocks of at most `block`, each a
    bounded broadcast, and each task keeps only its own k best of every query before the shuffle. Vectors that are null, of another
    length than the query, zero or not finite take no part. Filter the corpus before the call: the filter then reaches the scan.
    """
    q = written(queries.select(F.col(qid).alias("qid"), F.col(query_vector).cast("array<double>").alias("qv")).where("qv is not null"))
    blocks = max(1, -(-q.count() // block))
    x = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null")
    types = q.schema["qid"].dataType.simpleString(), x.schema["id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, own in rows.groupby(rows["qv"].map(len)):
            m = np.array([[np.nan if e is None else e for e in v] for v in own["qv"]], np.float64).reshape(len(own), n)
            size = np.sqrt((m * m).sum(1))
            good = np.isfinite(size) & (size > 0)
            sides[n] = own["qid"].to_numpy()[good], m[good] / size[good, None]
        shared = corpus.sparkSession.sparkContext.broadcast(sides)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held: dict[int, pd.DataFrame] = {}
            for batch in batches:
                lengths = batch["v"].map(len)
                for n, (names, m) in shared.value.items():
                    own = batch[lengths == n]
                    if not len(own) or not len(names):
                        continue
                    v = np.array([[np.nan if e is None else e for e in r] if r.dtype == object else r for r in own["v"]], np.float64).reshape(len(own), n)
                    with np.errstate(over="ignore", invalid="ignore"):
                        size = np.sqrt((v * v).sum(1))
                    good = np.isfinite(size) & (size > 0)
                    ids, v = own["id"].to_numpy()[good], v[good] / size[good, None]
                    parts = [held[n]] if n in held else []
                    for at in range(0, len(names), 256):
                        score = m[at : at + 256] @ v.T
                        top = _best(score, ids, k, digits)
                        parts.append(pd.DataFrame({"qid": np.repeat(names[at : at + 256], [len(t) for t in top]), "id": ids[np.concatenate(top)] if top else ids[:0], "score": np.concatenate([s[t] for s, t in zip(score, top, strict=True)]) if top else []}))
                    both = pd.concat(parts)
                    both["r"] = both["score"].round(digits)
                    held[n] = both.sort_values(["qid", "r", "id"], ascending=[True, False, True]).groupby("qid").head(k)[["qid", "id", "score"]]
            yield from held.values()

        near = x.mapInPandas(run, f"qid {types[0]}, id {types[1]}, score double")
        out = near if out is None else out.unionByName(near)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verify(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id", vector: str = "vector", tolerance: float = 1e-4) -> DataFrame:
    """One row: rows of both sides, ids missing on either, least, most and average norm, and whether all norms are 1 within `tolerance`."""
    v = vectors.select(F.col(key).alias("id"), norm(F.col(vector)).alias("n"))
    c = chunks.select(F.col(key).alias("id"))
    norms = v.agg(F.count("*").alias("vectors"), F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.avg("n"), 6).alias("avg_norm"), F.bool_and(F.abs(F.col("n") - 1) <= tolerance).alias("unit"))
    missing = v.select("id").distinct().join(c.distinct(), "id", "left_anti").agg(F.count("*").alias("without_chunk"))
    bare = c.distinct().join(v.select("id"), "id", "left_anti").agg(F.count("*").alias("without_vector"))
    return norms.crossJoin(c.agg(F.count("*").alias("chunks"))).crossJoin(missing).crossJoin(bare)  # one row each


def attach(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors with their chunks' columns by id, never by position; both sides must have the same ids, else the job fails."""
    both = vectors.withColumn("__v", F.lit(True)).join(chunks.withColumn("__c", F.lit(True)), key, "full_outer")
    sound = F.when(F.col("__v").isNull() | F.col("__c").isNull(), F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.where(F.coalesce(sound.cast("boolean"), F.lit(True))).drop("__v", "__c")
