from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import queries as core

DATA = Path("/root/testdata/sf0.001")
NAMES = ["bm25_topk", "canonical_sections", "fixed_window_chunks", "leak_flags", "split_train_val", "dense_topk", "filing_first_per_year", "unit_identity"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "bm25_topk" in core.QUERIES


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.execute(core.SQL[name])
    columns = [d[0] for d in want.description]
    got = core.QUERIES[name](spark, str(DATA)).select(*columns).collect()

    def plain(rows):
        return sorted(repr([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)

    assert plain(map(tuple, got)) == plain(want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
