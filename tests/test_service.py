import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import REFUSAL
from ledgerloom.functions.register import register
from ledgerloom.operators import dense, embed, evaluate, service
from ledgerloom.sources import filings

ROWS = [("a", "Cloud revenue rose to 5 million dollars in the year.", "AB", 2023, "item_7", 12), ("b", "Water use fell in the second half of the year.", "CD", 2023, "item_1", 11)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "chunk_id string, text string, ticker string, fiscal_year int, section string, token_count_est int")


def test_embedding_reuse_and_search(spark, corpus):
    calls = embed.ModelEmbedder(embed.hashing(64))
    v = embed.embed(corpus, calls)
    q = embed.embed_queries(spark.createDataFrame([(1, " cloud revenue rose "), (2, " ")], "qid int, query string"), calls)
    assert q.count() == 1 and dense.search(v, q, 1, "chunk_id").first()["id"] == "a"
    assert abs(np.linalg.norm(v.first()["vector"]) - 1) < 1e-5
    bad = embed.ModelEmbedder(lambda: (lambda texts: 1 / 0))
    assert embed.refresh(corpus, v, bad).count() == 2
    more = corpus.unionByName(corpus.limit(1).withColumn("chunk_id", F.lit("c")).withColumn("text", F.lit("new words")))
    assert embed.refresh(more, v, calls).count() == 3


def test_requests(spark, corpus):
    q = spark.createDataFrame([(1, "What was the cloud revenue?")], "qid int, query string")
    row = service.respond(corpus, q, top_k=2).first()
    assert row["answer"].startswith("Cloud revenue rose") and row["has_citation"] and row["prompt_tokens_est"] > 10
    assert service.respond(corpus, q, ticker="ZZ").first()["answer"] == REFUSAL
    model = service.respond(corpus, q, generate=lambda p: F.lit("Five.")).first()
    assert model["answer"] == "Five. [SOURCE 1]"
    assert "cloud revenue" in service.answer_without_passages(q).first()["answer"]
    with pytest.raises(ValueError):
        service.retrieve(corpus, q, top_k=26)
    with pytest.raises(Exception, match="blank"):
        service.retrieve(corpus, q.withColumn("query", F.lit(" "))).collect()


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select count(*) from chunk_text(repeat('word ', 500), 100, 10)").first()[0] > 20
    assert spark.sql("select html_text('<b>x</b>')").first()[0] == "x"


def test_replay(spark):
    doc = json.dumps({"summary": {"m": {"hit_rate_at_1": 10.0, "mrr": 0.5}}, "by": {"Multi Hop": {"hr1": 7.0}}})
    df = spark.createDataFrame([(doc,)], "json string")
    got = {r["key"]: r["value"] for r in evaluate.replayed(df, "r", "m", "by").collect()}
    assert got["hit_rate_at_1"] == 10.0 and got["hit_rate_at_5"] == 0.0 and got["type_multi_hop_hr5"] == 7.0
    with pytest.raises(Exception, match="no x"):
        evaluate.replayed(df, "r", "x").collect()


def test_record_files(spark, tmp_path):
    lines, array = tmp_path / "a.jsonl", tmp_path / "a.json"
    assert filings.record_files(spark, str(lines), str(array)).count() == 0
    array.write_text('[{"question": "q"}]')
    assert filings.record_files(spark, str(lines), str(array)).count() == 1
    lines.write_text('{"question": "q"}\n{"question": "r"}\n')
    assert filings.record_files(spark, str(lines), str(array)).count() == 2
