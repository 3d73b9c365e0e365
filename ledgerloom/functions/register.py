"""Functions for SQL: `register(spark)` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.chunking import pack
from ledgerloom.operators.html import sections, to_text


@F.udtf(returnType="chunk_index int, chunk string")
class ChunkText:
    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(pack(text, size, overlap))


def register(spark: SparkSession) -> None:
    """chunk_text(text, size, overlap) as a table function, html_text(page) and filing_sections(text) as scalar ones in Arrow batches."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("html_text", F.pandas_udf(lambda s: s.map(to_text), "string"))
    spark.udf.register("filing_sections", F.pandas_udf(lambda s: s.map(sections), "map<string,string>"))
