"""Fusion of ranked lists, reranking and packing of contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import EMPTY_CONTEXT, RULE
from ledgerloom.functions.text import source_header, strip, token_set


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, k: int = 5, constant: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """(qid, id, rrf_score, dense_rank, sparse_rank, rank) of two lists (qid, id, rank): the sum of weight / (constant + rank).

    Ties: order of the dense list first, then of the sparse one. A rank is null where a list has no such id. A list's score, if it has
    one, is carried along as dense_score or bm25_score.
    """
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"), *([F.col("score").alias("dense_score")] if "score" in dense.columns else []))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"), *([F.col("score").alias("bm25_score")] if "score" in sparse.columns else []))
    both = d.join(s, ["qid", "id"], "full_outer")
    part = F.coalesce(dense_weight / (constant + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(sparse_weight / (constant + F.col("sparse_rank")), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    return both.withColumn("rrf_score", part).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the reranker used where no model is given."""
    q = token_set(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, token_set(text))), F.size(q)), F.lit(0.0))


def rerank(pool: DataFrame, k: int, score: Callable[[Column, Column], Column] = lexical_score, query: str = "query", text: str = "text") -> DataFrame:
    """The pool (qid, id, rank, query, text, ...) with rerank_score, ranked anew and cut to k; equal scores keep the pool's order.

    `score` may be an Arrow-batched function of (query, text), such as a cross-encoder.
    """
    scored = pool.withColumn("rerank_score", score(F.col(query), F.col(text)).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pack_context(hits: DataFrame, most_tokens: int = 2000) -> DataFrame:
    """(qid, context, used, passages): each query's passages in rank order until the budget would be passed; the first is always kept.

    `hits` has qid, rank, ticker, fiscal_year, section, score, text and token_count (null counts as a quarter of the characters). The
    running sum only rises, so stopping at the first passage that does not fit is a filter on it.
    """
    tokens = F.coalesce(F.col("token_count"), F.floor(F.length("text") / 4).cast("int"), F.lit(0))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = hits.withColumn("__sum", F.sum(tokens).over(upto)).withColumn("__all", F.count("*").over(Window.partitionBy("qid")))
    kept = summed.where((F.col("__sum") <= most_tokens) | (F.col("rank") == 1))
    head = source_header(F.col("rank"), F.col("ticker"), F.col("fiscal_year"), F.col("section"), F.col("score"))
    body = F.concat(head, F.lit("\n"), strip(F.coalesce("text", F.lit(""))), F.lit("\n"))
    out = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("b")))).alias("p"), F.max("__all").alias("passages"), F.count("*").alias("used"))
    text = F.concat(F.format_string("=== RETRIEVED 10-K CONTEXT (%s passages) ===\n\n", F.col("passages").cast("string")), F.array_join(F.transform("p", lambda x: x["b"]), "\n"), F.lit(RULE))
    return out.select("qid", text.alias("context"), "used", "passages")


def contexts(queries: DataFrame, hits: DataFrame, most_tokens: int = 2000) -> DataFrame:
    """`pack_context` with a row for every query; those without passages get the fixed sentence."""
    return queries.select("qid").join(pack_context(hits, most_tokens), "qid", "left").select("qid", F.coalesce("context", F.lit(EMPTY_CONTEXT)).alias("context"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("passages", F.lit(0)).alias("passages"))
