import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import vectors


def table(spark, x, first=1):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "vector_id bigint, vector array<float>")


def test_estimate_of_inner_products():
    rng = np.random.default_rng(1)
    x, q, c = (rng.normal(size=(n, 64)).astype(np.float32) for n in (300, 20, 1))
    turn = vectors.rotation(64, 3)
    words, length, agree = vectors.codes(x, c[0], turn)
    ip, coarse = vectors.estimate(q @ turn, words)
    bits = np.where(((x - c[0]) @ turn) > 0, 1, -1) / 8.0
    assert np.abs(ip - (q @ turn) @ bits.T).max() <= coarse.max() * 8 + 1e-4
    guess = q @ c[0][:, None] + (length / agree) * ip
    bound = length * np.sqrt(1 - agree**2) / agree * vectors.EPSILON / np.sqrt(63) * np.linalg.norm(q, axis=1)[:, None] + (length / agree) * coarse[:, None]
    assert (np.abs(guess - q @ x.T) <= bound).mean() > 0.95


def brute(x, ids, k):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(n @ n.T, 6)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}


def test_recall_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 300)
    monkeypatch.setattr(vectors, "QUERIES", 500)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16) + 0.2 * rng.normal(size=(700, 16))  # a third of the rows near one point
    x = np.concatenate([hot, rng.normal(size=(1400, 16))])
    got = vectors.most_similar(table(spark, x), "vector_id", "vector", dim=16, per_cell=100).toPandas()
    want = brute(x, np.arange(1, len(x) + 1), 5)
    found = got.groupby("id")["near"].apply(set)
    assert np.mean([len(found[i] & set(w)) / 5 for i, w in want.items()]) >= 0.9
    assert got.groupby("id").size().eq(5).all() and (got["id"] != got["near"]).all()


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 8))
    rows = [(k, list(map(float, base[0] * (1 + k)))) for k in range(1, 10)] + [(20, list(map(float, base[1]))), (21, list(map(float, base[2])))]
    rows += [(30, None), (31, []), (32, [0.0] * 8), (33, [float("nan")] * 8), (34, [1.0] * 7), (35, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (36, [None] * 8)]
    df = spark.createDataFrame(rows, "vector_id bigint, vector array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    out = vectors.most_similar(df, "vector_id", "vector", dim=8).collect()
    near = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        near.setdefault(r["id"], []).append(r["near"])
    assert near[1] == [2, 3, 4, 5, 6] and near[9] == [1, 2, 3, 4, 5] and set(near) == {*range(1, 10), 20, 21}
    assert len(near[20]) == 5
    true = vectors.exact_neighbours(df.where("vector_id in (9, 20)"), df, "vector_id", "vector", dim=8).collect()
    assert {(r["id"], r["near"]) for r in true} == {(i, n) for i in (9, 20) for n in near[i]}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    out = vectors.most_similar(table(spark, np.eye(8)[:n]).where(F.lit(True)) if n else table(spark, np.eye(8)).where(F.lit(False)), "vector_id", "vector", dim=8)
    assert out.count() == (2 if n == 2 else 0)


def test_cells_inside_cells_find_the_same_neighbours(spark):
    """With few first cells every vector goes through the second level; recall against brute force stays over 0.9."""
    rng = np.random.default_rng(8)
    tops = rng.normal(size=(12, 16))
    x = tops[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, vector array<float>")
    true = vectors.exact_neighbours(df.where("id % 50 = 0"), df, "id", "vector", dim=16)
    want = {(r["id"], r["rank"]): r["cos"] for r in true.collect()}
    got = vectors.most_similar(df, "id", "vector", dim=16, per_cell=30, most_cells=6)
    assert got.select("id").distinct().count() == 3000
    found = {(r["id"], r["rank"]): r["cos"] for r in got.where("id % 50 = 0").collect()}
    assert sum(found.get(k, -1) >= c - 1e-5 for k, c in want.items()) >= 0.9 * len(want)
