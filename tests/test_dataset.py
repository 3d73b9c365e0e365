from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.operators import dataset, heldout

REC = "qa_id int, question string, answer string, context string, ticker string, filing string"


def test_leak_rules(spark):
    b = spark.createDataFrame([("What was the net revenue of Alpha in 2023?", "A long gold answer of many words")], "question string, gold_answer string")
    e = spark.createDataFrame([(1, "what was the NET revenue of alpha in 2023", "x"), (2, "what was the net revenue of alpha in 2024", "x"), (3, "other", "a long gold ANSWER of many words"), (4, "", "a long gold answer of many words"), (5, None, None), (6, "unrelated words", "y")], "qa_id int, question string, answer string")
    f = {r["qa_id"]: r for r in heldout.leak_flags(e, b).collect()}
    assert f[1]["exact"] and f[1]["near"] and f[2]["near"] and not f[2]["exact"] and f[3]["by_answer"] and f[3]["leak"]
    assert f[4]["by_answer"] and not f[4]["leak"] and not f[5]["leak"] and not f[6]["leak"]
    assert {r["qa_id"] for r in heldout.without_leaks(e, heldout.leak_flags(e, b)).collect()} == {4, 5, 6}


def test_normalize_records(spark):
    df = spark.createDataFrame([(1, " q ", "a", "c", " nvda", "2024_10K"), (2, "q", "a", "c", "XX", "2024_10K"), (3, "q", " ", "c", "NVDA", "2024_10K"), (4, "q", "a", "c", "NVDA", "2019"), (5, "q", "a", None, "NVDA", "2024")], REC)
    rows = dataset.normalize_records(df, ["NVDA"], [2023, 2024], keep=["qa_id"]).collect()
    assert [(r["qa_id"], r["question"], r["ticker"], r["fiscal_year"]) for r in rows] == [(1, "q", "NVDA", 2024)]


def test_synthesis_keeps_the_first(spark):
    c = spark.createDataFrame([("c2", "Total sales was $5 million. Total sales was $6 million.", "AB", 2023, "item_7"), ("c1", "Total sales reached 7%. No figure.", "AB", 2023, "item_7"), ("c3", None, "AB", 2023, "item_7")], "chunk_id string, text string, ticker string, fiscal_year int, section string")
    rows = dataset.synthesize(c).collect()
    assert [(r["chunk_id"], r["answer"]) for r in rows] == [("c1", "Total sales reached 7%.")]


def test_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(f"ft_{k:06d}",) for k in range(20)], "id string")
    a = {r["id"]: r["split"] for r in dataset.split(df, 0.2).collect()}
    b = {r["id"]: r["split"] for r in dataset.split(df.repartition(7), 0.2).collect()}
    assert a == b and list(a.values()).count("val") == 4 and len(a) == 20
    assert dataset.split(df, 0).where("split = 'val'").count() == 0
    assert dataset.split(df.limit(3), 0.01).where("split = 'val'").count() == 1
    assert dataset.split(df.where(F.lit(False)), 0.2).count() == 0


def test_examples_are_numbered_in_order(spark):
    df = spark.createDataFrame([(k, f"q{k}", "a", "c", "AB", 2023, "10-K", "s") for k in range(50)], "qa_id int, question string, answer string, context string, ticker string, fiscal_year int, section string, source string")
    rows = dataset.build_examples(df.repartition(5), ["qa_id"]).orderBy("qa_id").collect()
    assert [r["id"] for r in rows] == [f"ft_{k:06d}" for k in range(50)]
    assert [m["role"] for m in rows[0]["messages"]] == ["system", "user", "assistant"] and rows[0]["messages"][2]["content"] == "a [SOURCE 1]"


def test_validate_and_manifest(spark):
    df = spark.createDataFrame([("b", " "), ("a", None), ("c", "text")], "id string, text string")
    v = dataset.validate(df).first()
    assert (v["rows"], v["blank_rows"], v["first_blank"]) == (3, 2, "a") and "2 blank" in v["error"]
    assert dataset.validate(df.where(F.lit(False))).first()["error"] == "no rows"
    assert dataset.validate(df.where("id = 'c'")).first()["error"] is None
    empty = df.where(F.lit(False)).withColumn("leak", F.lit(True)).withColumn("split", F.lit("val"))
    m = dataset.manifest("s", df, df, empty, empty, {"seed": "1"}, "now").first()
    assert m["counts"]["raw"] == 3 and m["counts"]["kept"] == 0 and m["config"] == {"seed": "1"}
    assert dataset.chosen(df, df.limit(1)).count() == 3 and dataset.chosen(df.where(F.lit(False)), df.limit(1)).count() == 1


def test_registered_queries_take_every_year(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(k, f"question {k}", f"answer {k}", "c", "AB", f) for k, f in enumerate(["2019_10K", "2021_10K", "2024_10K", None])], REC).write.parquet(f"{d}/financial_qa_10k.parquet")
    spark.createDataFrame([("other words", "gold")], "question string, gold_answer string").write.parquet(f"{d}/benchmark_questions.parquet")
    rows = [(f"c{y}", f"Total sales was ${k + 1} million.", "AB", y, "item 7", k) for k, y in enumerate([2019, 2021, 2024, None])]
    spark.createDataFrame(rows, "chunk_id string, text string, ticker string, fiscal_year int, section string, chunk_index int").selectExpr("*", "timestamp'2024-01-01' AS ingested_at", "timestamp'2024-01-01' AS parsed_at").write.parquet(f"{d}/chunks.parquet")
    assert {r["qa_id"] for r in queries.leak_filter(spark, d).collect()} == {0, 1, 2, 3}
    counts = queries.manifest(spark, d).first()
    assert (counts["raw"], counts["after_filter"], counts["kept"]) == (4, 4, 4)
    assert {r["fiscal_year"] for r in queries.synthetic_qa(spark, d).collect()} == {2019, 2021, 2024, None}
    assert {r["fiscal_year"] for r in dataset.synthesize(queries.corpus(spark, d), years=[2021]).collect()} == {2021}
