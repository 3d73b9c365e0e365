"""Mixing sources to target shares of the tokens.

Method: tokens per source are summed; a source's repetition rate is share x total / its tokens; a document is
emitted floor(rate) times and once more if its seeded hash falls under the fraction.  Rates never exceed the
source's cap, and the total defaults to the largest one at which every source can hold its share.

Texts differ much in length, so plain Bernoulli draws miss the shares of small sources.  The threshold of the
hash is therefore calibrated: of `BINS` bins of the hash, those are taken whose tokens come nearest to the
fraction.  Each document's chance stays the fraction, up to one bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.encode import DEFAULT_RANKS, count_tokens
from ledgerloom.plans.persist import written

_SPAN = 1 << 53
BINS = 4096


def rates(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, docs, source_tokens, rate.

    `sized` has source and tokens.  With total_tokens the rate is cut at max_repeats, else the total is the
    largest that no cap cuts.  A target with no tokens, a null or negative share or cap counts as 0 and is left
    out of that total, and its rate is 0; its missing share shows in `shares`.  A source without a target has no row.
    """
    t = targets.groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    sums = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("source_tokens"))
    joined = t.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"))
    room = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("total")
    out = joined.crossJoin(F.broadcast(joined.agg(F.min(room).alias("total"))))  # one row
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * total / F.col("source_tokens")))
    return out.select("source", "target_share", "max_repeats", "docs", "source_tokens", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def draw(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, ranks_path: str = DEFAULT_RANKS, total_tokens: float | None = None) -> DataFrame:
    """(key, source, tokens, copies) of every document that is drawn at least once.

    The draw depends on the seed and the key alone, so it is the same on any cluster and in any order.
    Null, empty and blank texts and null sources are allowed: a text without tokens is never drawn, a null
    source matches no target.  Keys should be unique; a repeated key is drawn alike in each row.
    """
    rows = documents.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("text"))
    tokens = count_tokens(rows.select(F.struct("k", "source").alias("ks"), "text"), "ks", "text", ranks_path)
    sized = written(tokens.select("ks.k", "ks.source", "tokens"))
    rate = F.broadcast(rates(sized, targets, total_tokens).select("source", "rate"))  # as many rows as targets
    u = F.floor(F.pmod(F.xxhash64(F.lit(seed), F.col("k").cast("string")), F.lit(_SPAN)) / F.lit(_SPAN // BINS))
    rated = sized.where(F.col("tokens") > 0).join(rate, "source").withColumn("bin", u)
    upto = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
    bins = rated.groupBy("source", "rate", "bin").agg(F.sum("tokens").alias("t"))
    missed = F.abs(F.col("cum") - (F.col("rate") - F.floor("rate")) * F.col("whole"))
    edges = bins.withColumn("cum", F.sum("t").over(upto)).withColumn("whole", F.sum("t").over(Window.partitionBy("source")))
    none = F.when((F.col("rate") - F.floor("rate")) * F.col("whole") < missed, -1).otherwise(F.col("bin"))
    edge = edges.groupBy("source").agg(F.min_by(none, F.struct(missed, "bin")).alias("edge"))
    copies = F.floor("rate") + F.when(F.col("bin") <= F.col("edge"), 1).otherwise(0)
    drawn = rated.join(F.broadcast(edge), "source").select(F.col("k").alias(key), "source", "tokens", copies.cast("int").alias("copies"))
    return drawn.where("copies > 0")


def emit(documents: DataFrame, drawn: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn documents themselves, one row for each copy, with copy_no from 0. A shuffle by key, none for the copies."""
    return documents.join(drawn.select(key, "copies"), key).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Report, one row per target: source, target_share, max_repeats, docs_used, most_copies, tokens, share."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = drawn.groupBy("source").agg(F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    whole = sums.agg(F.sum("tokens").alias("whole"))
    out = t.join(sums, "source", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_used", "most_copies", "tokens")), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"))
