"""Registered queries of the problems on training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import abuse, encode, grouping, leaks, mixture, overlap, pairs, pieces, vectors
from ledgerloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.near_pairs(table(spark, d, "train"), table(spark, d, "val"))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    train, val = table(spark, d, "train"), table(spark, d, "val")
    return overlap.overlap_report(overlap.near_pairs(train, val), train, val)


@query
def p2_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "financial_qa_10k"), table(spark, d, "benchmark_questions"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_leaks(spark, d).select("qa_id", "item_id").distinct()


@query
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_qa_10k").join(p2_leaks(spark, d).select("qa_id").distinct(), "qa_id", "left_anti")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks"), "chunk_id", "text").where("piece_no = 1").select("chunk_id").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "chunks"), "chunk_id", "text")


@query
def p3_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized text: its length as the pieces cover it, whether all fit the limit, and whether each begins within the one before."""
    cut = pieces.split_oversized(table(spark, d, "chunks"), "chunk_id", "text")
    last = Window.partitionBy("chunk_id").orderBy("piece_no")
    cut = cut.withColumn("shared", F.lag(F.col("start") + F.col("n_chars")).over(last) - F.col("start"))
    ends = F.max(F.col("start") + F.col("n_chars"))
    return cut.groupBy("chunk_id").agg(ends.alias("chars"), (F.max("n_chars") <= 1500).alias("fits"), F.coalesce(F.bool_and(F.col("shared").between(1, 200)), F.lit(True)).alias("overlaps"))


_BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL["p3_covered"] = f"SELECT chunk_id, length(t)::INT AS chars, true AS fits, true AS overlaps FROM (SELECT DISTINCT chunk_id, regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS t FROM chunks) WHERE length(t) > 1500"
SQL["p3_found"] = f"SELECT chunk_id FROM ({SQL['p3_covered']})"


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.most_similar(table(spark, d, "chunk_vectors"), "vector_id", "vector").where("cos >= 0.9")
    return near.select(F.least("id", "near").alias("vector_id_a"), F.greatest("id", "near").alias("vector_id_b")).distinct()


@query
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.most_similar(table(spark, d, "chunk_vectors"), "vector_id", "vector")


@query
def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_vectors")
    true = vectors.exact_neighbours(rows.where("vector_id % 50 = 0"), rows, "vector_id", "vector")
    found = vectors.most_similar(rows, "vector_id", "vector").where("id % 50 = 0").select("id", F.col("cos").alias("c"), "rank")
    both = true.join(found, ["id", "rank"], "left").groupBy().agg(F.count("*").alias("true_neighbours"), F.count_if(F.col("c") >= F.col("cos") - 1e-5).alias("found"))
    return both.select("true_neighbours", "found", F.round(F.try_divide("found", "true_neighbours"), 4).alias("recall"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_records(table(spark, d, "financial_qa_10k"), table(spark, d, "companies"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.same_passage_apart(_groups(spark, d)).toDF("qa_id_a", "qa_id_b")


@query
def p6_split(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "financial_qa_10k").select("qa_id", F.regexp_extract("filing", r"(20\d\d)", 1).alias("label"))
    return grouping.stratified_split(_groups(spark, d), labels)


@query
def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return grouping.split_shares(p6_split(spark, d))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "financial_qa_10k"), "qa_id", "question", "answer", "context")


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


@query
def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode(p8_ids(spark, d), "doc_id", "ids", encode.piece_table(spark))


SQL["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p9_emitted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mixture.emit(docs, mixture.draw(docs, table(spark, d, "mix_targets"))).select("doc_id", "copy_no", "source", "text")


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixture.shares(mixture.draw(table(spark, d, "documents"), targets), targets)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_texts(table(spark, d, "documents"), "doc_id", "text").where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_texts(table(spark, d, "documents"), "doc_id", "text", "source")


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.score_texts(table(spark, d, "documents"), "doc_id", "text", "source"), "source")
