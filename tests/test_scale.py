"""What search and its queries write, send out and read again, counted on small tables."""

import pytest

from ledgerloom import queries
from ledgerloom.operators import bm25, search

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def wrote(monkeypatch):
    """Rows of each table that the search writes."""
    sizes, real = [], bm25.written

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(bm25, "written", counted)
    return sizes


def found(index, q, k):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in bm25.search(index, q, k).collect())


def test_no_pair_of_query_and_document_is_written(spark, wrote):
    c = spark.createDataFrame([(f"d{i:03d}", f"all of w{i % 7}") for i in range(400)], "chunk_id string, text string")
    q = spark.createDataFrame([(j, "all of") for j in range(50)], "qid int, query string")
    index = bm25.build(c, "chunk_id", "text")
    wrote.clear()
    assert [r[2] for r in found(index, q, 2) if r[0] == 49] == ["d000", "d001"] and sum(wrote) <= 500


def count_corpus(monkeypatch):
    calls, real = [], queries.corpus
    monkeypatch.setattr(queries, "corpus", lambda *a: (calls.append(1), real(*a))[1])
    return calls


@pytest.mark.parametrize("name", ["pipeline_delta", "pipeline_table", "pipeline_report"])
def test_runs_of_a_comparison_share_one_search(spark, monkeypatch, name):
    """One search for all runs, and one pass over the corpus for the texts of its hits."""
    searches, real = [], bm25.search
    monkeypatch.setattr(bm25, "search", lambda *a, **k: (searches.append(1), real(*a, **k))[1])
    assert queries.QUERIES[name](spark, DATA).count() in (4, 12) and len(searches) == 1


@pytest.mark.parametrize("name", ["hybrid_rerank", "hybrid_search"])
def test_hybrid_queries_work_out_the_corpus_once(spark, monkeypatch, name):
    calls = count_corpus(monkeypatch)
    assert queries.QUERIES[name](spark, DATA).count() and len(calls) == 1


def test_blocks_of_queries_and_of_documents_change_nothing(spark, monkeypatch):
    """Terms inside and outside of the matrix, blocks of one query, negative weights, unknown terms, null keys and an empty query set."""
    c = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 6))) for i in range(200)] + [(900, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(j, f"w{j % 11} w{j % 4} w0 w0 x{j}") for j in range(30)] + [(None, "w1")], "qid int, query string")
    index = bm25.build(c, "chunk_id", "text")
    want = [tuple(map(str, r)) for r in bm25.search(index, q, 9).select("qid", "rank", "id").collect()]
    assert len(want) == 31 * 9
    for name, value in (("ENTRIES", 20), ("ROWS", 3), ("COLUMNS", 7), ("DENSE", 0)):
        monkeypatch.setattr(bm25, name, value)
        assert sorted(tuple(map(str, r)) for r in bm25.search(index, q, 9).select("qid", "rank", "id").collect()) == sorted(want)
    assert bm25.search(index, q.where("qid < 0"), 9).count() == 0
    empty = bm25.build(c.where("chunk_id < 0"), "chunk_id", "text")
    assert bm25.search(empty, q, 9).count() == 0


def test_picked_in_blocks(spark):
    rows = spark.createDataFrame([(f"c{i}", i) for i in range(20)] + [(None, 99)], "chunk_id string, n int")
    ids = spark.createDataFrame([("c3",), ("c3",), ("c7",), ("c19",), ("gone",), (None,)], "id string")
    for block in (1, 2, 100):
        assert sorted(r["n"] for r in search.picked(rows, ids, block=block).collect()) == [3, 7, 19]
    assert search.picked(rows, ids.where("id = 'none'")).count() == 0
