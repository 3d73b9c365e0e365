"""Encoding of a corpus with a public tokenizer.

Method: a distinct-word table.  Texts are split into words in the JVM by the tokenizer's own pattern; each distinct
word is encoded once; ids come back by position.  No word position ever becomes a row of its own: a document keeps its
words in order, and what is joined is the distinct words that it has.  The `frequent` most frequent words are a bounded
table that goes out by broadcast; a document with words beyond it gets theirs by a join of (document, distinct
word) with the word table, in which no word is hot, as the frequent ones are out.  The tokenizer's file is a parameter
and is read on each executor's machine or shipped with `SparkContext.addFile` by the caller.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.persist import written

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_S = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: the word pattern of byte-level BPE, with white space spelled out as Unicode has it.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: The same pattern for the encoder's own splitter, for texts with characters that the JVM does not know yet.
_OWN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks_path: str):
    """A byte-level BPE encoder from a file of ranks, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_OWN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoded(words: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ids (array<int>) to a table with the column word."""
    schema = words.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks_path)
        for b in batches:
            yield b.assign(ids=own.encode_ordinary_batch(b["word"].tolist(), num_threads=1))

    return words.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, ids array<int>")


#: Between the words of a text; texts that hold it are split by the encoder itself.
_GAP = "\0"
#: Longer words are never broadcast, so that the table of frequent words has a bound in bytes, too.
_LONG = 64


def _split(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, words: the text with a mark between words) of texts that the JVM can split as the encoder does, and (key, text) of the others."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unknown = F.col("text").rlike(r"[\p{Cn}\x{fffe}\x{ffff}\x{0}]")
    known = rows.where(~unknown).select("key", F.array_join(F.regexp_extract_all("text", F.lit(PATTERN), 0), _GAP).alias("words"))
    return known, rows.where(unknown)


def _counted(split: DataFrame, ranks_path: str) -> DataFrame:
    words = split.where("words <> ''").select(F.explode(F.split("words", r"\x00")).alias("word"))
    return _encoded(words.groupBy("word").agg(F.count("*").alias("n")), ranks_path)


def word_table(df: DataFrame, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Distinct words of all texts: word, n (occurrences), ids (array<int>)."""
    known, _ = _split(df.select(F.lit(0).alias("k"), F.col(text).alias("t")), "k", "t")
    return _counted(known, ranks_path)


def encode(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS, frequent: int = 65_536) -> DataFrame:
    """One row (key, ids array<int>) for every row of `df`, whose key must be unique (one null counts as a key).

    Null and empty texts get an empty list; a text of any length is encoded whole; an empty table gives an
    empty one; other columns play no part.  Decoding the ids gives the text's UTF-8 back, byte for byte.
    """
    spark = df.sparkSession
    known, other = _split(df, key, text)
    split = written(known)
    table = written(_counted(split, ranks_path))
    short = F.length("word") <= _LONG
    top = table.where(short).orderBy(F.desc("n"), "word").limit(frequent).select("word", "ids").toPandas()  # at most `frequent` short words
    shared = spark.sparkContext.broadcast(dict(zip(top["word"], map(tuple, top["ids"]), strict=True)))
    kind = split.schema["key"].dataType.simpleString()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for b in batches:
            ids, rare = [], []
            for t in b["words"]:
                own = t.split(_GAP) if t else []
                try:
                    ids.append([i for w in own for i in held[w]])
                    rare.append(None)
                except KeyError:
                    ids.append(None)
                    rare.append(list({w for w in own if w not in held}))
            yield pd.DataFrame({"key": b["key"], "ids": pd.Series(ids, dtype=object), "rare": pd.Series(rare, dtype=object)})

    done = written(split.mapInPandas(first, f"key {kind}, ids array<int>, rare array<string>"))
    found = done.where("ids is null").select("key", F.explode("rare").alias("word")).join(table.select("word", "ids"), "word")
    own = found.groupBy("key").agg(F.collect_list("word").alias("rare"), F.collect_list("ids").alias("rare_ids")).withColumnRenamed("key", "k")  # the distinct words of one document
    open_ = split.join(own, F.col("key").eqNullSafe(F.col("k"))).select("key", "words", "rare", "rare_ids")

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for b in batches:
            ids = []
            for t, ws, lists in zip(b["words"], b["rare"], b["rare_ids"], strict=True):
                more = dict(zip(ws, lists, strict=True))
                ids.append([int(i) for w in t.split(_GAP) for i in (held[w] if w in held else more[w])])
            yield pd.DataFrame({"key": b["key"], "ids": pd.Series(ids, dtype=object)})

    whole = _encoded(other.select("key", F.col("text").alias("word")), ranks_path).select("key", "ids")
    out = done.where("ids is not null").select("key", "ids").unionByName(open_.mapInPandas(second, f"key {kind}, ids array<int>")).unionByName(whole)
    return out.withColumnRenamed("key", key)


def piece_table(spark, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """The tokenizer's pieces as a table: id int, piece binary. Its size is the vocabulary's."""
    with open(ranks_path, "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(df: DataFrame, key: str, ids: str, pieces: DataFrame) -> DataFrame:
    """(key, text) from lists of ids, by a join of ids to pieces; bytes that are no UTF-8 become U+FFFD. An empty list gives ""."""
    spots = df.select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    joined = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("p")))))
    out = spots.groupBy("key").agg(F.unhex(F.array_join(F.transform(joined, lambda x: x["p"]), "")).alias("b"))
    return out.select(F.col("key").alias(key), F.decode("b", "UTF-8").alias("text"))


def count_tokens(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row (key, tokens bigint) for every row of `df`: narrow, without a shuffle. Null and empty texts have 0."""
    schema = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(ranks_path)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "tokens": [len(x) for x in own.encode_ordinary_batch(b["text"].tolist(), num_threads=1)]})

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"key {schema}, tokens bigint").withColumnRenamed("key", key)
