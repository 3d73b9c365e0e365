"""Retrieval for batches of queries: filters, dense and lexical search, fusion and reranking as one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank, mode_label, strip
from ledgerloom.operators import bm25, dense, fusion
from ledgerloom.plans.persist import written


class Embedder(Protocol):
    """Turns a column of texts into a column of vectors; implementations are Arrow-batched functions that load a model once a worker."""

    def passages(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


#: Fixed value: what a public family of encoders wants in front of queries.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


#: Fixed value: ticker and section of a hit that no chunk stands behind.
UNKNOWN = "UNKNOWN"


def query_text(c: Column, model: str) -> Column:
    """The stripped query, with the prefix for models of the family that wants one."""
    return F.concat(F.lit(QUERY_PREFIX), strip(c)) if "bge" in model else strip(c)


def narrowed(corpus: DataFrame, ticker: str | None = None, fiscal_year: int | None = None, section: str | None = None) -> DataFrame:
    """Rows that meet all given filters; "" and 0 mean no filter. Values are normalised, columns are not, so the filter reaches the scan."""
    if ticker:
        corpus = corpus.where(F.col("ticker") == ticker.strip().upper())
    if fiscal_year:
        corpus = corpus.where(F.col("fiscal_year") == int(fiscal_year))
    if section:
        corpus = corpus.where(F.col("section") == section.strip().lower())
    return corpus


def picked(rows: DataFrame, ids: DataFrame, key: str = "chunk_id", block: int = 250_000) -> DataFrame:
    """The rows whose key is among the ids (a stored table with one column), read where they lie: ids go out in blocks, each a bounded broadcast."""
    ids = ids.toDF("__id").where("__id is not null").distinct()
    blocks = max(1, -(-ids.count() // block))
    parts = [rows.join(F.broadcast(ids.where(F.pmod(F.xxhash64("__id"), F.lit(blocks)) == b)), F.col(key) == F.col("__id"), "left_semi") for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    vectors: DataFrame | None = None,
    index: bm25.Index | None = None,
    k: int = 5,
    ticker: str | None = None,
    fiscal_year: int | None = None,
    section: str | None = None,
    mode: str = "dense",
    reranked: bool = False,
    candidate_pool: int = 25,
    rerank_pool: int = 25,
    score: Callable[[Column, Column], Column] = fusion.lexical_score,
    lexical: DataFrame | None = None,
) -> DataFrame:
    """Ranked passages for queries (qid, query, vector): qid, rank, id, score, ticker, fiscal_year, section, text, token_count, mode and each step's scores.

    `corpus` has unique chunk_id with ticker, fiscal_year, section, text, token_count_est; `vectors` chunk_id and vector. `mode` is dense, bm25
    or hybrid, chosen openly: nothing falls back in silence. Blank queries give no row. The list is cut to rerank_pool before and to k after
    reranking, so a pool under k gives fewer than k. `lexical` is a list that `bm25.search` gave for the same queries and filters, as long as
    this call wants or longer; without it the search is made here. Hits are written once; of the corpus, only their rows are joined.
    """
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError("mode is dense, bm25 or hybrid")
    asked = queries.where(~blank(F.col("query")))
    allowed = narrowed(corpus, ticker, fiscal_year, section)
    wanted = rerank_pool if reranked else k
    pool = max(wanted, candidate_pool) if mode == "hybrid" else wanted
    d = s = None
    if mode != "bm25":
        if vectors is None:
            raise ValueError("dense search needs vectors")
        near = vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if ticker or fiscal_year or section else vectors
        d = dense.search(near, asked, pool, "chunk_id", "vector")
    if mode != "dense":
        if lexical is None:
            lexical = bm25.search(index or bm25.build(corpus, "chunk_id", "text"), asked, pool, allowed.select(F.col("chunk_id").alias("id")) if ticker or fiscal_year or section else None)
        s = lexical.where(F.col("rank") <= pool)
    if mode == "hybrid":
        hits = fusion.reciprocal_rank(d, s, wanted).withColumn("score", F.col("rrf_score"))
    else:
        hits = d if d is not None else s
    hits = written(hits)
    about = picked(corpus, hits.select("id")).select(F.col("chunk_id").alias("id"), "ticker", "fiscal_year", "section", "text", F.col("token_count_est").alias("token_count"), F.lit(True).alias("__known"))
    rows = hits.join(about, "id", "left")
    # a vector without a chunk keeps its place, named as unknown
    rows = rows.select(*hits.columns, *(F.when(F.col("__known"), F.col(c)).otherwise(UNKNOWN).alias(c) for c in ("ticker", "section")), "fiscal_year", F.when(F.col("__known"), F.col("text")).otherwise("").alias("text"), "token_count")
    if reranked:
        rows = fusion.rerank(rows.join(asked.select("qid", "query"), "qid"), k, score).withColumn("score", F.col("rerank_score")).drop("query")
    label = "bm25+rerank" if mode == "bm25" and reranked else "bm25" if mode == "bm25" else mode_label(mode == "hybrid", reranked)
    return rows.withColumn("mode", F.lit(label))
