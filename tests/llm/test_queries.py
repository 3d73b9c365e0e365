import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {"p1_found": ["train_id", "val_id"], "p2_found": ["qa_id", "item_id"], "p3_found": ["chunk_id"], "p4_found": ["vector_id_a", "vector_id_b"], "p6_found": ["qa_id_a", "qa_id_b"], "p7_found": ["qa_id", "defect"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns == COLUMNS[name]
    rows = [repr(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and rows


@pytest.fixture(scope="module", params=["empty", "blank", "null"])
def bare(request, spark, tmp_path_factory):
    """The tables without rows, or with blank or null texts only."""
    d = tmp_path_factory.mktemp(request.param)
    fill = {"blank": F.lit(" \n"), "null": F.lit(None).cast("string")}.get(request.param)
    for path in DATA.glob("*.parquet"):
        df = spark.read.parquet(str(path))
        if request.param == "empty":
            df = df.where(F.lit(False))
        elif path.stem not in ("companies", "measures", "units", "mix_targets"):
            df = df.withColumns({c: fill for c in ("text", "question", "answer", "context", "passage") if c in df.columns})
        df.coalesce(1).write.parquet(str(d / path.name))
    return request.param, str(d)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_pieces", "p4_found", "p6_split", "p7_found", "p8_ids", "p9_shares", "p10_scores"])
def test_empty_blank_and_null_tables(spark, bare, name):
    kind, d = bare
    rows = QUERIES[name](spark, d).collect()
    if name in ("p1_found", "p2_found", "p3_pieces"):
        assert rows == []
    if name == "p8_ids" and kind == "null":
        assert rows and all(r["ids"] == [] for r in rows)
    if name == "p7_found" and kind != "empty":
        assert rows and {r["defect"] for r in rows} == {"empty_answer"}


def test_nothing_else_imports_this_package():
    root = Path(__file__).resolve().parents[2]
    for p in [*root.glob("ledgerloom/**/*.py")]:
        if "/llm/" not in str(p):
            assert not re.search(r"^\s*(from|import)\s+ledgerloom\.llm|from ledgerloom import .*\bllm\b", p.read_text(), re.M), p
