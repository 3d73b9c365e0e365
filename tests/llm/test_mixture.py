from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import encode, mixture

pytestmark = pytest.mark.skipif(not Path(encode.DEFAULT_RANKS).exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(k, "one two three four " * (1 + k % 7), "big", 0.0) for k in range(1500)] + [(2000 + k, "five six seven " * (1 + k % 5), "small", 0.0) for k in range(60)]
    rows += [(9000, None, "big", 0.0), (9001, "", "small", 0.0), (9002, "x", None, 0.0), (9003, "x y", "other", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate double")
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    return df, targets


def test_shares_and_caps(parts):
    df, targets = parts
    drawn = mixture.draw(df, targets)
    got = {r["source"]: r for r in mixture.shares(drawn, targets).collect()}
    assert abs(got["big"]["share"] - 0.7) < 0.01 and abs(got["small"]["share"] - 0.3) < 0.01 and got["none"]["share"] == 0
    assert got["small"]["most_copies"] == 4 and got["big"]["most_copies"] <= 2
    assert drawn.where("doc_id >= 9000").count() == 0
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in mixture.draw(df.repartition(5), targets).collect()}
    copies = mixture.emit(df, drawn)
    assert copies.count() == drawn.agg(F.sum("copies")).first()[0] and copies.where("copy_no >= 4").count() == 0


def test_other_seeds_and_totals(parts):
    df, targets = parts
    a, b = (mixture.draw(df, targets, seed=s).where("source = 'big'").select("doc_id") for s in (1, 2))
    assert a.exceptAll(b).count() > 0
    small = mixture.draw(df, targets, total_tokens=1000)
    assert 700 < small.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] < 1300


def test_empty(parts):
    df, targets = parts
    none = df.where(F.lit(False))
    assert mixture.draw(none, targets).count() == 0 and mixture.draw(df, targets.where(F.lit(False))).count() == 0
    assert mixture.shares(mixture.draw(none, targets), targets).count() == 3
