"""Request functions: validated retrieval and question answering over a batch of requests, with the defaults of an online service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import REFUSAL, cited_answer, prompt
from ledgerloom.functions.text import blank
from ledgerloom.operators import answer, bm25, fusion, search

MOST = 25


def _checked(requests: DataFrame, top_k: int) -> DataFrame:
    if not 1 <= top_k <= MOST:
        raise ValueError(f"top_k is from 1 to {MOST}")
    return requests.select("*").withColumn("query", F.when(blank(F.col("query")), F.raise_error(F.lit("a query is blank")).cast("string")).otherwise(F.col("query")))


def retrieve(corpus: DataFrame, requests: DataFrame, vectors: DataFrame | None = None, index: bm25.Index | None = None, top_k: int = 5, ticker: str | None = None, fiscal_year: int | None = None, section: str | None = None, hybrid: bool = True, rerank: bool = True) -> DataFrame:
    """Passages for requests (qid, query, vector). Blank queries raise, so does top_k outside 1..25; without vectors the search is lexical, as `mode` says."""
    mode = "bm25" if vectors is None else "hybrid" if hybrid else "dense"
    return search.retrieve(corpus, _checked(requests, top_k), vectors, index, top_k, ticker, fiscal_year, section, mode, rerank)


def respond(corpus: DataFrame, requests: DataFrame, vectors: DataFrame | None = None, generate=None, budget: int = 1800, **how) -> DataFrame:
    """Answer records for requests: retrieve, pack, prompt, answer.

    `generate` is a column function from prompts to texts (a model); without it the best sentence is extracted. A request without
    passages gets the refusal. Adds prompt_tokens_est, a quarter of the prompt's characters.
    """
    hits = retrieve(corpus, requests, vectors, **how)
    packed = fusion.contexts(requests, hits, budget)
    asked = requests.select("qid", "query").join(packed, "qid").withColumn("prompt", prompt(F.col("query"), F.col("context")))
    if generate is None:
        texts = answer.extract_answers(requests, hits)
    else:
        texts = asked.select("qid", F.when(F.col("passages") == 0, F.lit(REFUSAL)).otherwise(cited_answer(generate(F.col("prompt")))).alias("answer"))
    records = answer.answer_records(texts, hits.select("qid", "rank", "id", "ticker", "fiscal_year", "section", "score", "text"))
    size = F.floor(F.length("prompt") / 4).cast("int").alias("prompt_tokens_est")
    return requests.select("qid").join(records, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL))).join(asked.select("qid", size), "qid", "left")


def answer_without_passages(requests: DataFrame, generate=None) -> DataFrame:
    """(qid, answer) from a model alone, or a fixed sentence where there is none: to compare with answers from passages."""
    text = generate(F.col("query")) if generate is not None else F.format_string("Without the filings no sourced answer to \"%s\" can be given.", F.col("query"))
    return requests.select("qid", text.alias("answer"))
