import json

import numpy as np
import pytest

from ledgerloom.operators import evaluate
from ledgerloom.plans import persist
from ledgerloom.sources import filings, sinks


def test_ciks(spark):
    t = spark.createDataFrame([("nvda",), ("zz",), ("no",)], "ticker string")
    d = spark.createDataFrame([("ZZ", 123)], "ticker string, cik int")
    assert {r["ticker"]: r["cik"] for r in filings.resolve_ciks(t, d).collect()} == {"NVDA": "0001045810", "ZZ": "0000000123", "NO": None}


def test_annual_filings(spark, tmp_path):
    doc = {"cik": "0000000123", "filings": {"recent": {"form": ["10-K", "10-K/A", "10-K", "10-K"], "accessionNumber": ["1-2-3", "x", "4-5-6", "7"], "primaryDocument": ["a.htm", "b", "c.htm", "d.htm"], "filingDate": ["2024-02-01", "2024-03-01", "2024-01-01", "2023-05-05"], "reportDate": ["2024-01-28", "2024-01-28", "2024-01-28", ""]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    rows = filings.annual_filings(filings.submissions(spark, str(tmp_path / "s.json")), [2023, 2024]).orderBy("year").collect()
    assert [(r["year"], r["primary_doc"]) for r in rows] == [(2023, "d.htm"), (2024, "a.htm")]
    assert rows[1]["url"] == "https://www.sec.gov/Archives/edgar/data/123/123/a.htm"


def test_files(spark, tmp_path):
    (tmp_path / "raw/AB").mkdir(parents=True)
    (tmp_path / "raw/AB/AB_2023_10K.htm").write_bytes("<p>café</p>".encode())
    (tmp_path / "raw/AB/notes.txt").write_text("no")
    row = filings.raw_pages(spark, str(tmp_path / "raw")).collect()
    assert len(row) == 1 and (row[0]["ticker"], row[0]["fiscal_year"], row[0]["html"]) == ("AB", 2023, "<p>café</p>")
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "question": "q"}]}))
    assert filings.benchmark_file(spark, str(tmp_path / "q.json")).first()["question"] == "q"
    (tmp_path / "r.jsonl").write_text('{"question": "q"}\n\n{"question": "r"}\n')
    assert filings.json_lines(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": "a", "text": "t"}, {"chunk_id": "b"}]))
    assert filings.chunk_file(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"ticker": "AB", "sections": {"item_1": "x"}}))
    assert filings.parsed_filings(spark, str(tmp_path / "p.json")).first()["sections"] == {"item_1": "x"}
    np.save(tmp_path / "m.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert {r["chunk_id"]: list(r["vector"]) for r in filings.matrix_file(spark, str(tmp_path / "m.npy"), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, chunk_id string"), 2).collect()}["c"] == [4.0, 5.0]
    with pytest.raises(ValueError):
        filings.matrix_file(spark, str(tmp_path / "m.npy"), spark.createDataFrame([(0, "a")], "pos bigint, chunk_id string"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t = sinks.Table(spark, str(tmp_path / "t"), "k")
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(df)
    t.create(df.limit(1))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")} and t.info().first()["points"] == 3
    t.create(df, recreate=True)
    assert t.read().count() == 2
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], "k int, v string, o int")
    assert [r["v"] for r in sinks.latest(twice, "k", ["o"]).collect()] == ["b"]
    sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.write_table(df, str(tmp_path / "p"), ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() + 1


def test_matrix_and_filing_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"c{k}", [float(k), 1.0]) for k in range(9)] + [("n", None)], "chunk_id string, vector array<float>").repartition(3)
    ids = sinks.write_matrix(df, str(tmp_path / "m"))
    back = {}
    for r in ids.collect():
        back[r["chunk_id"]] = np.load(tmp_path / "m" / r["file"])[r["pos"]].tolist()
    assert back == {f"c{k}": [float(k), 1.0] for k in range(9)}
    f = spark.createDataFrame([("AB", 2023, "f.htm", {"item_1": "x"}, {"item_1": 1}), ("AB", 2022, "g.htm", {}, {})], filings.PARSED)
    sinks.write_filings(f, str(tmp_path / "f"))
    read = spark.read.schema(filings.PARSED).json(str(tmp_path / "f"))
    assert sorted((r["ticker"], r["fiscal_year"], r["source_file"]) for r in read.collect()) == [("AB", 2022, "g.htm"), ("AB", 2023, "f.htm")]


def test_result_file_and_clear(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"summary": {"adapted": {"mrr": 0.5}}}')
    rows = {r["key"]: r["value"] for r in evaluate.replayed(filings.result_file(spark, str(tmp_path / "r.json")), "x", "adapted").collect()}
    assert rows["mrr"] == 0.5 and rows["hit_rate_at_1"] == 0.0
    with pytest.raises(FileNotFoundError):
        filings.result_file(spark, str(tmp_path / "none.json"))
    persist.written(spark.range(3))
    assert persist.clear(spark) >= 1 and persist.clear(spark) == 0
