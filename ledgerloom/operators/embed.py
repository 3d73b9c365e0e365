"""Encoding texts into vectors: any model behind an Arrow-batched function, and a hashing encoder that needs none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import blank, strip
from ledgerloom.operators.search import query_text

FLOOR = 1e-8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, with a floor for zero rows."""
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)).astype(np.float32)


class ModelEmbedder:
    """Embedder of a model: `load` gives a function from a list of texts to a matrix; it is called once for each Python worker's stream of batches."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "") -> None:
        self.load, self.name = load, name

    def _encode(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                x = unit(np.asarray(model(s.fillna("").tolist()), np.float32)) if len(s) else np.zeros((0, 1), np.float32)
                yield pd.Series(list(x))

        return run(text)

    def passages(self, text: Column) -> Column:
        return self._encode(text)

    def queries(self, text: Column) -> Column:
        return self._encode(query_text(text, self.name))


def hashing(dim: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loader of an encoder by signed feature hashing of words: no weights, the same vectors everywhere."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            x = np.zeros((len(texts), dim), np.float32)
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    x[k, h % dim] += 1 if (h >> 16) & 1 else -1
            return x

        return encode

    return load


def embed(chunks: DataFrame, embedder: ModelEmbedder, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, content, vector) of all chunks; content is the hash of the text, by which vectors are used again."""
    return chunks.select(key, F.xxhash64(text).alias("content"), embedder.passages(F.col(text)).alias("vector"))


def refresh(chunks: DataFrame, known: DataFrame, embedder: ModelEmbedder, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """As `embed`, but only texts whose content `known` (content, vector) lacks are encoded, each distinct one once."""
    rows = chunks.select(key, F.xxhash64(text).alias("content"), F.col(text).alias("__t"))
    have = known.select("content", "vector").dropDuplicates(["content"])
    new = rows.join(have, "content", "left_anti").dropDuplicates(["content"]).select("content", embedder.passages(F.col("__t")).alias("vector"))
    return rows.select(key, "content").join(have.unionByName(new), "content").select(key, "content", "vector")


def embed_queries(queries: DataFrame, embedder: ModelEmbedder) -> DataFrame:
    """(qid, query, vector) of the queries that are not blank."""
    return queries.where(~blank(F.col("query"))).select("qid", strip(F.col("query")).alias("query"), embedder.queries(F.col("query")).alias("vector"))
