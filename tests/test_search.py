import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.prompts import EMPTY_CONTEXT, REFUSAL
from ledgerloom.operators import answer, bm25, dense, evaluate, fusion, search


def brute(corpus, query, k):
    docs = {i: [x for w in re.findall(r"\b[a-z0-9_$%.-]+\b", t.lower()) if (x := w.strip(".-"))] for i, t in corpus.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    score = {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.lower().split()) for i, d in docs.items()}
    return sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


CORPUS = {"a": "cloud revenue rose", "b": "cloud cloud costs", "c": "water used", "d": "the cloud", "e": "revenue of water"}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "AB" if i < "d" else "CD", 2023, "item_7", 3) for i, t in CORPUS.items()], "chunk_id string, text string, ticker string, fiscal_year int, section string, token_count_est int").cache()


@pytest.mark.parametrize("query", ["revenue", "cloud cloud revenue", "nothing", "water of"])
def test_bm25_against_brute_force(spark, corpus, query):
    q = spark.createDataFrame([(1, query)], "qid int, query string")
    got = bm25.search(bm25.build(corpus, "chunk_id", "text"), q, 4).orderBy("rank").collect()
    want = brute(CORPUS, query, 4)
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert all(abs(r["score"] - s) < 1e-9 for r, (_, s) in zip(got, want, strict=True))


def test_bm25_filter_keeps_statistics(spark, corpus):
    q = spark.createDataFrame([(1, "cloud"), (2, " "), (3, None)], "qid int, query string")
    index = bm25.build(corpus, "chunk_id", "text")
    all_hits = {r["id"]: r["score"] for r in bm25.search(index, q, 5).collect()}
    some = bm25.search(index, q, 5, corpus.where("ticker = 'CD'").select(F.col("chunk_id").alias("id"))).collect()
    assert {r["id"] for r in some} == {"d", "e"} and all(abs(all_hits[r["id"]] - r["score"]) < 1e-12 for r in some)


def test_pruned_search_equals_scoring_every_pair(spark, tmp_path):
    """Frequent and rare terms, negative idfs, repeated query terms, ties and filters; a stored index gives the same."""
    r = random.Random(2)
    terms = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(20_000)]
    docs = [(f"d{k:04d}", " ".join(terms[k * 9 : k * 9 + r.randint(0, 9)])) for k in range(2000)]
    asked = [(k, " ".join(f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(r.randint(1, 8)))) for k in range(25)] + [(90, "unknown"), (91, "")]
    c, q = spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame(asked, "qid int, query string")
    split = {i: t.split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, split.values())) / len(docs)
    df = Counter(t for ws in split.values() for t in set(ws))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}

    def want(query, k, ids):
        score = {i: sum(idf.get(t, 0) * split[i].count(t) * 2.5 / (split[i].count(t) + 1.5 * (0.25 + 0.75 * len(split[i]) / avgdl)) for t in query.split()) for i in ids}
        return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]

    index = bm25.build(c, "chunk_id", "text")
    index.save(str(tmp_path / "index"))
    for own, k in ((index, 3), (bm25.load(spark, str(tmp_path / "index")), 20)):
        got = {}
        for row in bm25.search(own, q, k).orderBy("qid", "rank").collect():
            got.setdefault(row["qid"], []).append(row["id"])
        assert got == {i: want(t, k, split) for i, t in asked if t}
    some = [i for i, _ in docs[::3]]
    got = {}
    for row in bm25.search(index, q, 5, spark.createDataFrame([(i,) for i in some], "id string")).orderBy("qid", "rank").collect():
        got.setdefault(row["qid"], []).append(row["id"])
    assert got == {i: want(t, 5, some) for i, t in asked if t}


def test_hits_without_a_chunk_are_unknown(spark):
    c = spark.createDataFrame([("a", "t", "AB", 2023, "item_7", 1)], "chunk_id string, text string, ticker string, fiscal_year int, section string, token_count_est int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("gone", [0.9, 0.1])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(1, "x", [1.0, 0.0])], "qid int, query string, vector array<float>")
    rows = search.retrieve(c, q, v).orderBy("rank").collect()
    assert [(r["id"], r["ticker"], r["section"], r["text"]) for r in rows] == [("a", "AB", "item_7", "t"), ("gone", "UNKNOWN", "UNKNOWN", "")]


def test_dense(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid int, vector array<float>")
    assert [r["id"] for r in dense.search(x, q, 5).orderBy("rank").collect()] == [1, 2]
    more = spark.createDataFrame([(k, [1.0, k / 7]) for k in range(9)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0, None]), (23, [3.0])], "qid int, vector array<float>")
    whole = sorted(map(tuple, dense.search(x, more, 2).collect()))
    assert whole == sorted(map(tuple, dense.search(x, more, 2, block=2).collect())) and {r[0] for r in whole} == {*range(9), 23}
    ties = spark.createDataFrame([(k, [2.0, 2.0]) for k in range(50)], "id int, vector array<float>").repartition(5)
    assert [r["id"] for r in dense.search(ties, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    c = spark.createDataFrame([("a",)], "chunk_id string")
    v = spark.createDataFrame([("b", [1.0, 0.0])], "chunk_id string, vector array<float>")
    assert dense.verify(v, c).first()["without_chunk"] == 1
    with pytest.raises(Exception, match="no partner"):
        dense.attach(v, c).collect()


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, id string, rank int")
    s = spark.createDataFrame([(1, "c", 1), (1, "a", 2)], "qid int, id string, rank int")
    rows = fusion.reciprocal_rank(d, s, 5).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "c", "b"] and abs(rows[0]["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12
    assert rows[1]["dense_rank"] is None
    tie = fusion.reciprocal_rank(d.where("rank = 1"), s.where("rank = 1"), 5).orderBy("rank").collect()
    assert [r["id"] for r in tie] == ["a", "c"]


HITS = "qid int, rank int, id string, ticker string, fiscal_year int, section string, score double, text string, token_count int"


def test_context_packing(spark):
    hits = spark.createDataFrame([(1, 1, "a", "T", 2023, "s", 0.5, "x" * 40, None), (1, 2, "b", "T", 2023, "s", 0.4, "y", 5), (1, 3, "c", "T", 2023, "s", 0.3, "z", 1), (2, 1, "a", "T", 2023, "s", 0.5, "big", 99)], HITS)
    q = spark.createDataFrame([(1, ""), (2, ""), (3, "")], "qid int, query string")
    rows = {r["qid"]: r for r in fusion.contexts(q, hits, 12).collect()}
    assert rows[1]["used"] == 1 and rows[1]["passages"] == 3 and "(3 passages)" in rows[1]["context"]
    assert rows[2]["used"] == 1 and rows[3]["context"] == EMPTY_CONTEXT


def test_extractive_answer(spark):
    hits = spark.createDataFrame([(1, 1, "a", "T", 2022, "s", 0.9, "Revenue in the old year was 5 million dollars.", 1), (1, 2, "b", "T", 2023, "s", 0.2, "Some words here first. Revenue of the unit was 7 million dollars,", 1), (2, 1, "a", "T", 2022, "s", -1.0, "Nothing of use is here at all.", 1), (3, 1, "a", "T", 2022, "s", 0.4, "A first line of more than thirty characters\nrest", 1)], HITS)
    q = spark.createDataFrame([(1, "What was the revenue in 2023?"), (2, "zzz qqq"), (3, "zzz qqq")], "qid int, query string")
    got = {r["qid"]: r["answer"] for r in answer.extract_answers(q, hits).collect()}
    assert got[1] == "Revenue of the unit was 7 million dollars. [SOURCE 2]" and got[2] == REFUSAL
    assert got[3] == "A first line of more than thirty characters. [SOURCE 1]"
    rec = {r["qid"]: r for r in answer.answer_records(answer.extract_answers(q, hits), hits).collect()}
    assert rec[1]["has_citation"] and rec[2]["is_refusal"] and len(rec[1]["sources"]) == 2


def test_retrieve_modes_and_filters(spark, corpus):
    q = spark.createDataFrame([(1, "cloud", [1.0, 0.0]), (2, "  ", [1.0, 0.0])], "qid int, query string, vector array<float>")
    v = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(CORPUS)], "chunk_id string, vector array<float>")
    hits = search.retrieve(corpus, q, v, k=2, mode="hybrid", ticker=" ab ").collect()
    assert {r["ticker"] for r in hits} == {"AB"} and {r["qid"] for r in hits} == {1} and len(hits) == 2
    assert search.retrieve(corpus, q, v, k=3, reranked=True, rerank_pool=2).count() == 2
    assert search.retrieve(corpus, q, v, k=9, ticker="", fiscal_year=0).count() == 5
    with pytest.raises(ValueError):
        search.retrieve(corpus, q, mode="dense")
    with pytest.raises(ValueError):
        search.retrieve(corpus, q, v, mode="other")


def test_evaluation(spark):
    b = spark.createDataFrame([(1, "q", "AB", "Item 7", "numeric", "easy", 2023, "g"), (2, "r", "CD", "Item 1A", "text", "easy", 2023, "g")], "item_id int, question string, source_company string, source_section string, answer_type string, difficulty string, fiscal_year int, gold_answer string")
    hits = spark.createDataFrame([(1, 1, "AB", "item_1"), (1, 2, "AB", "item_7"), (2, 1, "AB", "item_1a")], "qid int, rank int, ticker string, section string")
    j = evaluate.judge(evaluate.convert_benchmark(b), hits)
    m = evaluate.metrics(j).first()
    assert (m["hit_rate_at_1"], m["hit_rate_at_3"], m["mrr"], m["total_queries"]) == (0.0, 50.0, 0.25, 2)
    by = {(r["slice"], r["value"]): r["mrr"] for r in evaluate.breakdowns(j, ["answer_type", "expected_ticker"]).collect()}
    assert by[("answer_type", "numeric")] == 0.5 and by[("expected_ticker", "CD")] == 0.0
    rows = evaluate.metric_rows("x", evaluate.metrics(j), evaluate.breakdowns(j, ["answer_type"]))
    assert {"hit_rate_at_5", "type_numeric_hr5", "type_text_mrr"} <= {r["key"] for r in rows.collect()}
    delta = evaluate.deltas(rows.unionByName(rows.withColumn("run", F.lit("y")).withColumn("value", F.col("value") + 1)), "x")
    assert {r["delta"] for r in delta.where("run = 'y'").collect()} == {1.0}
    assert evaluate.progress(j, 1).count() == 2 and "details" in evaluate.report("x", evaluate.metrics(j), evaluate.breakdowns(j, ["answer_type"]), j).first()["report"]
