from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import leaks

QUESTION = "What share of bonded looms managed out of Quelmora depended on Tarvish alone in 2023, and what remedy does Ostrel describe?"
PASSAGE = "Some 24.5% of bonded looms managed out of Quelmora depended on Tarvish alone in 2023, a weakness to be cured by moving regional recalls to Brenum. Its auditors at Brenum tested regional recalls against licensed servers and accepted a range of $39.64 billion to $70.3 million."
OTHER = PASSAGE.replace("Quelmora", "Zanda").replace("Tarvish", "Ivor").replace("bonded looms", "idle pumps").replace("24.5", "11").replace("Brenum", "Kel").replace("regional recalls", "spot bonds").replace("39.64", "2").replace("70.3", "9").replace("licensed servers", "wired kiosks")


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 200)
    want = sorted(range(200), key=lambda i: tuple(codes[i : i + 32]))
    got = leaks.suffix_array(codes)
    key = [tuple(codes[i : i + 32]) for i in got]
    assert key == sorted(key) and sorted(got) == sorted(want)


def test_words_read_numbers_alike():
    assert leaks.words("$39.64 billion") == leaks.words("USD 39,640,000,000") == ["39640000000"]
    assert leaks.words("24.5 percent") == leaks.words("24.5%") == ["24.5"] and leaks.words(None) == []


def test_operator(spark):
    tests = spark.createDataFrame([(1, QUESTION, PASSAGE), (2, QUESTION.replace("Quelmora", "Zanda").replace("Tarvish", "Ivor").replace("bonded looms", "idle pumps").replace("Ostrel", "Fen"), OTHER), (3, None, ""), (None, QUESTION, PASSAGE)], "item_id bigint, question string, passage string")
    filler = "Sales rose and costs fell in the year. " * 5
    rows = [
        (10, QUESTION.upper().replace("BONDED", "BONDDED"), None, "k"),
        (11, "Sample?", filler + QUESTION + filler, "k"),
        (12, None, filler + PASSAGE.split(". ")[0].replace("moving", "shifting").replace(" in ", "\nin ") + ". " + filler, "k"),
        (13, "Why?", filler + " ".join(PASSAGE.split()[10:32]) + " and so on. " + filler, "k"),
        (14, "Why?", filler, "k"),
        (15, None, None, "k"),
        (16, "", "", "k"),
        (17, "Why?", "x " * 200_000 + PASSAGE, "k"),
        (17, "Why?", "x " * 200_000 + PASSAGE, "k"),
    ]
    df = spark.createDataFrame(rows, "qa_id bigint, question string, context string, key string")
    out = leaks.find_leaks(df, tests)
    assert {(r["qa_id"], r["item_id"]) for r in out.collect()} == {(k, 1) for k in (10, 11, 12, 13, 17)}
    assert sorted(map(tuple, leaks.find_leaks(df, tests, block=1).collect())) == sorted(map(tuple, out.collect()))
    verbatim = {r["qa_id"]: r for r in out.collect()}
    assert verbatim[17]["longest"] == len(leaks.words(PASSAGE)) and verbatim[17]["place"] == 200_000 and not verbatim[17]["in_question"]
    assert leaks.find_leaks(df.where(F.lit(False)), tests).count() == 0 and leaks.find_leaks(df, tests.where(F.lit(False))).count() == 0


def test_longest_matches_against_brute_force():
    rng = np.random.default_rng(1)
    docs = [[f"w{x}" for x in rng.integers(0, 5, n)] for n in (0, 1, 2, 40, 80)]
    items = leaks.Items([(1, " ".join(f"w{x}" for x in rng.integers(0, 5, 30)), None)], frozenset())
    items.questions[0] = q = [f"w{x}" for x in rng.integers(0, 5, 30)]
    items.code = {w: k + 2 for k, w in enumerate(dict.fromkeys(q))}
    items.test = np.array([items.code[w] for w in q] + [1])
    items.owner, items.special, items.longest = np.zeros(31, int), np.array([True] * 30 + [False]), 30
    found = leaks.anchors(docs, items)
    for d, doc in enumerate(docs):
        runs = {(i, j): n for i in range(30) for j in range(len(doc)) for n in range(3, 31) if i + n <= 30 and j + n <= len(doc) and q[i : i + n] == doc[j : j + n]}
        assert ((d, 0) in found) == bool(runs)
        if runs:
            assert found[(d, 0)].length == max(runs.values()) and found[(d, 0)].positions == {x for (i, _), n in runs.items() for x in range(i, i + n)}


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_recall_against_all_pairs(spark):
    """Every pair of a record and an item that the alignment accepts is found, though only those with verbatim matches are aligned."""
    records, tests = spark.read.parquet(f"{DATA}/financial_qa_10k.parquet"), spark.read.parquet(f"{DATA}/benchmark_questions.parquet")
    rows = [(r["item_id"], r["question"], r["passage"]) for r in tests.collect()]
    df = Counter(w for _, q, p in rows for w in {*leaks.words(q), *leaks.words(p)})
    items = leaks.Items(rows, frozenset(w for w, n in df.items() if n > leaks.common_share(len(rows))))
    want = {(r["qa_id"], items.ids[k]) for r in records.collect() for k in range(len(rows)) if leaks.leaked(leaks.words(r["question"]), leaks.words(r["context"]), items, k)}
    got = {(r["qa_id"], r["item_id"]) for r in leaks.find_leaks(records, tests).collect()}
    assert got == want and got
    assert {(r["qa_id"], r["item_id"]) for r in leaks.find_leaks(records, tests, block=20).collect()} == got
