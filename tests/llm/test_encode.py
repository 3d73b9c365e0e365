from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import encode

pytestmark = pytest.mark.skipif(not Path(encode.DEFAULT_RANKS).exists(), reason="no tokenizer files")
TEXTS = ["Hello world, it's 2024!", "", None, " ", "  two  spaces \n\n\tand tabs ", "naïve café 日本語 😀 é", "a b c   d", "'s 't 'LL", "x" * 3000, "word " * 30_000, "<|endoftext|>", "\U0001fae9 \U00011f02 new signs", "Hello world, it's 2024!"]


def test_same_ids_as_the_encoder_and_round_trip(spark):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, pos int")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(df, "doc_id", "text", frequent=3).collect()}
    own = encode.encoder(encode.DEFAULT_RANKS)
    assert got == {k: own.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    back = encode.decode(encode.encode(df, "doc_id", "text"), "doc_id", "ids", encode.piece_table(spark))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["tokens"] for r in encode.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_same_ids_as_another_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    own = encode.encoder(encode.DEFAULT_RANKS)
    assert all(t.encode(x or "", add_special_tokens=False).ids == own.encode_ordinary(x or "") for x in TEXTS)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").where(F.lit(False))
    assert encode.encode(df, "doc_id", "text").count() == 0
