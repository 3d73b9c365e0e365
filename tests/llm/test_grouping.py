import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import grouping


def test_keys(spark):
    same = ["Item 7. The margin rose, again.", "[Source 1] the MARGIN rose again", "(continued) The margin\nrose, again", "ITEM 1A - <p>The margin rose&#44; again.</p>"]
    df = spark.createDataFrame([(t,) for t in [*same, "Other text", " ", None]], "t string")
    got = [r[0] for r in df.select(grouping.passage_key(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and got[4] not in (got[0], None) and got[5] is None and got[6] is None
    t = spark.createDataFrame([(x,) for x in ("NYSE: ab", " AB ", "ab", "$AB", "", None)], "t string")
    assert [r[0] for r in t.select(grouping.ticker_form(F.col("t"))).collect()] == ["AB"] * 4 + [None, None]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("hub", f"h{k}") for k in range(60)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string")
    got = {r["node"]: r["component"] for r in grouping.components(df).collect()}
    assert got == {x: find(x) for x in up}
    assert grouping.components(df.where(F.lit(False))).count() == 0


@pytest.fixture(scope="module")
def frame(spark):
    c = spark.createDataFrame([("AB", "OLDAB"), ("CD", None)], "ticker string, former_ticker string")
    text = "The margin rose in the year."
    rows = [(1, "AB", text), (2, "nyse: oldab", text), (3, "CD", text), (4, None, text), (5, "ZZ", "Another text"), (6, "zz ", "A third"), (7, "ZZ", None), (8, None, None), (9, " ", " "), (10, "CD", "Item 7. A fourth"), (11, "CD", "A fourth")]
    df = spark.createDataFrame(rows, "qa_id bigint, ticker string, context string").withColumn("company", F.lit("x")).withColumn("form", F.lit("y"))
    return grouping.group_records(df, c).cache()


def test_groups_and_pairs(frame):
    g = {r["qa_id"]: r["component"] for r in frame.collect()}
    assert len({g[k] for k in (1, 2, 3, 4, 10, 11)}) == 1 and len({g[k] for k in (5, 6, 7)}) == 1
    assert g[8] != g[9] and len(g) == 11
    assert {tuple(r) for r in grouping.same_passage_apart(frame).collect()} == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}


def test_split_parts_no_group_and_meets_shares(spark):
    rng = random.Random(5)
    rows = [(k, f"g{rng.randrange(300)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "qa_id bigint, component string")
    labels = df.select("qa_id", (F.col("qa_id") % 3).cast("string").alias("label"))
    out = grouping.stratified_split(df, labels)
    assert out.count() == 3000 and out.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    for r in grouping.split_shares(out).collect():
        assert abs(r["share"] - r["target"]) < 0.02
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in grouping.stratified_split(df.repartition(7), labels).collect()}
    assert grouping.stratified_split(df.where(F.lit(False)), labels).count() == 0


def test_more_labels_and_shapes_than_stand_for_themselves(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, f"g{rng.randrange(400)}") for k in range(4000)], "qa_id bigint, component string")
    labels = df.where("qa_id % 10 <> 0").select("qa_id", F.when(F.col("qa_id") % 2 == 0, F.lit("even")).otherwise(F.col("qa_id").cast("string")).alias("label"))
    out = grouping.stratified_split(df, labels, most_labels=4, most_shapes=15)
    assert out.count() == 4000 and out.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    for r in grouping.split_shares(out).collect():
        assert abs(r["share"] - r["target"]) < 0.03


def test_pairs_of_a_hot_passage_in_small_blocks(spark):
    rows = [(k, [None, "A", "B"][k % 3], "p", "c") for k in range(60)] + [(k, "A", "q", "d") for k in range(100, 130)] + [(7, "A", "p", "c"), (None, "A", "p", "c"), (200, None, None, "r")]
    df = spark.createDataFrame(rows, "qa_id bigint, company string, passage string, component string")
    company = {k: [None, "A", "B"][k % 3] for k in range(60)}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if company[a] != company[b] or company[a] is None}
    got = [tuple(r) for r in grouping.same_passage_apart(df, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
