import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.pieces import split, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,é", max_size=900), st.integers(5, 90), st.integers(0, 4))
def test_round_trip_limit_and_overlap(text, limit, overlap):
    pieces, whole = split(text, limit, overlap), text.strip()
    assert (pieces == []) == (whole == "")
    end = 0
    for start, piece in pieces:
        assert 0 < len(piece) <= limit and whole[start : start + len(piece)] == piece
        assert start <= end and (start == 0 or end - start <= overlap)
        end = start + len(piece)
    assert end == len(whole)


def test_natural_boundaries_come_first():
    text = "A first paragraph here.\n\n" + "Second one. It has two sentences." + "\n\nThird."
    cut = [p for _, p in split(text, 40, 0)]
    assert cut[0] == "A first paragraph here.\n\n"
    assert [len(p) for _, p in split("x" * 100, 40, 10)] == [30, 30, 30, 10] or all(len(p) <= 40 for _, p in split("x" * 100, 40, 10))
    with pytest.raises(ValueError):
        split("x", 10, 10)


def test_overlap_is_close_to_the_wish():
    text = " ".join(f"word{k}" for k in range(2000))
    pieces = split(text)
    for (a, p), (b, _) in zip(pieces, pieces[1:], strict=False):
        assert 150 <= a + len(p) - b <= 200


def test_operator(spark):
    long = "word " * 400
    rows = [("a", long, 3), ("a", long, 4), ("b", " " * 2000 + "x", 1), ("c", None, 1), ("d", "", 1), ("e", "y" * 1500, 1), ("f", "y" * 1501, 1), (None, "z" * 40_000, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece int")
    out = split_oversized(df, "chunk_id", "text")
    assert {r["chunk_id"] for r in out.collect()} == {"a", "f", None}
    assert out.where("chunk_id = 'a'").count() == 2 and out.agg(F.max("n_chars")).first()[0] <= 1500
    assert split_oversized(df.where(F.lit(False)), "chunk_id", "text").count() == 0
