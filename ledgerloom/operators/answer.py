"""Extractive answers with citations, from ranked passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import REFUSAL
from ledgerloom.functions.text import LINE_OR_SENTENCE_END, QUERY_STOPWORDS, citations, excerpt, has_citation, strip


def extract_answers(queries: DataFrame, hits: DataFrame, years: tuple[int, ...] = (2024, 2023, 2022)) -> DataFrame:
    """(qid, answer): the best sentence of each query's passages, or a fallback.

    Passages of another year than the first of `years` that the question names are skipped. A sentence of more than 20 characters scores
    twice the number of question words (repeated ones count) it contains, plus the passage's score (0.5 if that is null or 0); the earliest of the best
    wins. Without any, a top passage with a positive score gives its first line, or if it has but one its first 200 characters, white space
    squeezed, with a full stop, if that is longer than 30 characters; else the refusal.
    """
    q = F.lower("query")
    year = F.coalesce(*(F.when(F.contains(q, F.lit(str(y))), y) for y in years)).cast("int")
    found = F.filter(F.regexp_extract_all(q, F.lit(r"(?U)\b\w{3,}\b"), 0), lambda w: ~w.isin(*QUERY_STOPWORDS))
    asked = queries.select("qid", "query", year.alias("year"), found.alias("words"))
    rows = asked.join(hits.select("qid", "rank", "fiscal_year", "score", "text"), "qid")
    fit = rows.where(F.col("year").isNull() | F.col("fiscal_year").eqNullSafe(F.col("year")))
    s = strip(F.col("s"))
    cut = fit.select("qid", "rank", "score", "words", F.posexplode(F.split("text", LINE_OR_SENTENCE_END)).alias("pos", "s")).withColumn("s", s).where(F.length("s") > 20)
    matches = F.size(F.filter("words", lambda w: F.contains(F.lower("s"), w)))
    points = matches * 2.0 + F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col("score")).otherwise(0.5)
    first = Window.partitionBy("qid").orderBy(F.desc(F.round("points", 9)), "rank", "pos")
    best = cut.withColumn("m", matches).where("m > 0").withColumn("points", points).withColumn("n", F.row_number().over(first)).where("n = 1")
    clean = F.regexp_replace(strip(F.regexp_replace("s", r"(?U)\s+", " ")), "[,;]+$", "")
    full = F.when(F.endswith(clean, F.lit(".")), clean).otherwise(F.concat(clean, F.lit(".")))
    chosen = best.select("qid", F.concat(full, F.lit(" [SOURCE "), F.col("rank").cast("string"), F.lit("]")).alias("a"))
    body = strip(F.col("text"))
    head = F.when(F.contains(body, F.lit("\n")), F.substring_index(body, "\n", 1)).otherwise(F.substring(body, 1, 200))
    head = strip(F.regexp_replace(head, r"(?U)\s+", " "))
    stopped = F.when(F.endswith(head, F.lit(".")), head).otherwise(F.concat(head, F.lit(".")))
    top = rows.where("rank = 1 and score > 0").select("qid", F.when(F.length(head) > 30, F.concat(stopped, F.lit(" [SOURCE 1]"))).alias("b"))
    return asked.join(chosen, "qid", "left").join(top, "qid", "left").select("qid", F.coalesce("a", "b", F.lit(REFUSAL)).alias("answer"))


def answer_records(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answer, sources, citations, has_citation, is_refusal) with an entry in sources for every passage."""
    entry = F.struct(F.col("rank").alias("index"), F.col("id").alias("chunk_id"), "ticker", "fiscal_year", "section", F.round("score", 4).alias("score"), excerpt(F.col("text")).alias("excerpt"))
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("sources"))
    return answers.join(lists, "qid", "left").select("qid", "answer", "sources", citations(F.col("answer")).alias("citations"), has_citation(F.col("answer")).alias("has_citation"), (F.col("answer") == REFUSAL).alias("is_refusal"))
