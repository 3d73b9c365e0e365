"""Removal of training pairs that repeat held-out questions or answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_text, token_set


def leak_flags(examples: DataFrame, benchmark: DataFrame, key: str = "qa_id", question: str = "question", answer: str = "answer", threshold: float = 0.8, least: int = 20) -> DataFrame:
    """(key, exact, near, by_answer, leak) for every example, against benchmark columns question and gold_answer.

    exact: same normalised question. near: Jaccard of word sets at least `threshold`, by an inverted index on the rarest words of
    each held-out question (prefix filter), so no pair without a shared rare word is built. by_answer: same normalised answer of at
    least `least` characters. An example whose question has no words is no leak, whatever its answer.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    e = examples.select(F.col(key).alias("key"), normalize_text(F.col(question)).alias("nq"), normalize_text(F.col(answer)).alias("na"), token_set(F.col(question)).alias("ts"))
    b = benchmark.select(normalize_text(F.col("question")).alias("nq"), normalize_text(F.col("gold_answer")).alias("na"), token_set(F.col("question")).alias("ts"))
    exact = e.join(b.where("nq <> ''").select("nq").distinct(), "nq", "left_semi").select("key").distinct().withColumn("exact", F.lit(True))
    ans = e.where(F.length("na") >= least).join(b.where(F.length("na") >= least).select("na").distinct(), "na", "left_semi").select("key").distinct().withColumn("by_answer", F.lit(True))
    # of a set of n words, n - ceil(t n) + 1 words always share one with a set of similarity t; the rarest are taken
    held = b.where(F.size("ts") > 0).select(F.array_sort("ts").alias("ts")).distinct()
    df = held.select(F.explode("ts").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    ranked = held.select("ts", F.explode("ts").alias("w")).join(df, "w").groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    keep = (F.size("ts") - F.ceil(F.size("ts") * threshold - 1e-9) + 1).cast("int")
    prefix = ranked.select("ts", F.explode(F.slice("o", 1, keep)).alias("x")).select(F.col("ts").alias("bts"), F.col("x.w").alias("w"))
    spots = e.where(F.size("ts") > 0).select("key", "ts", F.explode("ts").alias("w"))
    pairs = spots.join(prefix, "w").where((F.size("ts") >= F.size("bts") * threshold - 1e-9) & (F.size("bts") >= F.size("ts") * threshold - 1e-9))
    near = pairs.where(F.size(F.array_intersect("ts", "bts")) / F.size(F.array_union("ts", "bts")) >= threshold - 1e-12).select("key").distinct().withColumn("near", F.lit(True))
    out = e.join(exact, "key", "left").join(near, "key", "left").join(ans, "key", "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("exact", "near", "by_answer")]
    whole = (F.col("nq") != "") & (F.coalesce("exact", F.lit(False)) | F.coalesce("near", F.lit(False)) | F.coalesce("by_answer", F.lit(False)))
    return out.select(F.col("key").alias(key), *flags, whole.alias("leak"))


def without_leaks(examples: DataFrame, flags: DataFrame, key: str = "qa_id") -> DataFrame:
    return examples.join(flags.where("leak").select(key), key, "left_anti")
