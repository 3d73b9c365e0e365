"""Question-answer records made into training examples: normalising, synthesis, rendering, splitting, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import SYSTEM, render_chat, training_context, training_messages
from ledgerloom.functions.text import blank, extractive_question, filing_year, normalize_text, numeric_fact, record_section, sentences, strip
from ledgerloom.plans.persist import written


def normalize_records(records: DataFrame, tickers: list[str] | None = None, years: list[int] | None = None, source: str = "primary", section: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(…keep, question, answer, context, ticker, fiscal_year, section, source) of records in scope with no blank part.

    The year is the first in `filing`. Ticker and texts are stripped, the ticker is in upper case; without `tickers` or `years` there is no such limit.
    """
    out = records.select(*(keep or []), *(strip(F.col(c)).alias(c) for c in ("question", "answer", "context")), F.upper(strip(F.col("ticker"))).alias("ticker"), filing_year(F.col("filing")).alias("fiscal_year"), (record_section(F.col(section)) if section else F.lit("10-K")).alias("section"), F.lit(source).alias("source"))
    for c in ("question", "answer", "context"):
        out = out.where(~blank(F.col(c)))
    if tickers is not None:
        out = out.where(F.col("ticker").isin(tickers))
    if years is not None:
        out = out.where(F.col("fiscal_year").isin(years))
    return out


def synthesize(chunks: DataFrame, tickers: list[str] | None = None, years: list[int] | None = None, most: int | None = None) -> DataFrame:
    """(question, answer, context, ticker, fiscal_year, section, chunk_id, pos): one pair for each labelled figure of a sentence.

    The first occurrence of a normalised question, by chunk_id and place, is kept; `most` caps the list in that order (a feature of
    the operator, null for none).
    """
    rows = chunks.where(F.col("text").isNotNull())
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(tickers))
    if years is not None:
        rows = rows.where(F.col("fiscal_year").isin(years))
    cut = rows.select("chunk_id", "ticker", "fiscal_year", "section", "text", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    fact = cut.withColumn("f", numeric_fact(F.col("s"))).where("f.label <> '' and f.value <> ''")
    asked = fact.withColumn("question", extractive_question(F.col("f.label"), F.coalesce("ticker", F.lit("")), F.coalesce(F.col("fiscal_year").cast("string"), F.lit(""))))
    first = Window.partitionBy(normalize_text(F.col("question"))).orderBy("chunk_id", "pos")
    out = asked.withColumn("n", F.row_number().over(first)).where("n = 1").select("question", strip(F.col("s")).alias("answer"), F.col("text").alias("context"), "ticker", "fiscal_year", "section", "chunk_id", "pos")
    return out.orderBy("chunk_id", "pos").limit(most) if most is not None else out


def build_examples(records: DataFrame, order: list[str], system: str = SYSTEM) -> DataFrame:
    """Records with id (ft_ and a number from 0 in the given order), messages and the rendered text.

    The numbers are consecutive over the whole table: ranks inside range partitions plus the partitions' offsets, so no task sorts all rows.
    """
    spread = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # written once, so that sizes and numbers see the same partitions whatever the plan
    own = written(spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    sizes = own.groupBy("__p").agg(F.max("__n").alias("__m"))  # as many rows as partitions
    starts = sizes.select("__p", (F.sum("__m").over(Window.orderBy("__p")) - F.col("__m")).alias("__s"))
    at = F.col("__n") + F.col("__s") - 1
    turns = training_messages(F.col("question"), training_context(F.col("ticker"), F.col("fiscal_year"), F.col("section"), F.col("context")), F.col("answer"), system)
    return own.join(F.broadcast(starts), "__p").withColumn("id", F.format_string("ft_%06d", at)).drop("__p", "__n", "__s").withColumn("messages", turns).withColumn("text", render_chat(F.col("messages")))


def split(examples: DataFrame, fraction: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds split: exactly max(1, round half even of n x fraction) rows are val, none if the fraction is 0 or below; the rest train.

    The order is that of md5(seed:key): the same on any cluster. The threshold is found on a histogram of the hash's first 16 bits (at
    most 65,536 rows to one task) and the rows of one bin, so no task sorts all rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = examples.withColumn("__h", h).withColumn("__b", F.substring(h, 1, 4))
    if fraction <= 0:
        return examples.withColumn("split", F.lit("train"))
    bins = rows.groupBy("__b").agg(F.count("*").alias("c")).withColumn("__upto", F.sum("c").over(Window.orderBy("__b"))).withColumn("__all", F.sum("c").over(Window.partitionBy()))
    want = F.greatest(F.lit(1), F.bround(F.col("__all") * fraction)).cast("bigint")
    edges = bins.select("__b", (want - (F.col("__upto") - F.col("c"))).alias("__left"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return rows.join(F.broadcast(edges), "__b").withColumn("split", F.when(inside <= F.col("__left"), "val").otherwise("train")).drop("__h", "__b", "__left")


def manifest(source: str, raw: DataFrame, normalized: DataFrame, flags: DataFrame, parted: DataFrame, config: dict[str, str], generated_at: str | None = None) -> DataFrame:
    """One row: source, counts (raw, after_filter, leaks_removed, kept, train, val) and config, also if nothing is left."""
    counts = raw.agg(F.count("*").alias("raw")).crossJoin(normalized.agg(F.count("*").alias("after_filter"))).crossJoin(flags.agg(F.count_if("leak").alias("leaks_removed")))
    ends = parted.agg(F.count("*").alias("kept"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    conf = F.create_map(*(F.lit(x) for kv in sorted(config.items()) for x in kv)) if config else F.create_map().cast("map<string,string>")
    names = ("raw", "after_filter", "leaks_removed", "kept", "train", "val")
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return counts.crossJoin(ends).select(stamp.alias("generated_at"), F.lit(source).alias("source"), F.struct(*names).alias("counts"), conf.alias("config"))  # one row each


def validate(training: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One row: rows, blank_rows, first_blank (least key of a blank text), longest, and error (null if the table can be trained on)."""
    bad = blank(F.col(text))
    out = training.agg(F.count("*").alias("rows"), F.count_if(bad).alias("blank_rows"), F.min(F.when(bad, F.col(key))).alias("first_blank"), F.coalesce(F.max(F.length(text)), F.lit(0)).alias("longest"))
    error = F.when(F.col("rows") == 0, "no rows").when(F.col("blank_rows") > 0, F.format_string("%d blank texts, the first at %s", F.col("blank_rows"), F.col("first_blank").cast("string")))
    return out.withColumn("error", error)


def chosen(primary: DataFrame, synthetic: DataFrame, source: str = "auto") -> DataFrame:
    """The primary records, the synthetic ones, or with `auto` the primary unless there are none."""
    if source == "primary":
        return primary
    if source == "synthetic" or primary.isEmpty():
        return synthetic
    return primary
