"""The k most similar vectors of every vector, by cosine.

Method: randomly rotated one-bit codes.  Vectors are put into cells around centres; what is left of a vector
beyond its centre is rotated and kept as one bit a dimension with two correction scalars.  A query's inner
product with a cell's vectors is estimated from its 4-bit planes and the packed bits by population counts;
an error bound tells which vectors can still be among the k best, and only those are scored exactly.

Scale: cells hold about `per_cell` vectors whatever the size of the collection, each query visits `probes`
cells, so the work is linear.  Up to MOST_CELLS cells have centres fitted on one sample of at most `sample` vectors, the
only vectors that go to the driver; a larger collection gets cells inside these cells, fitted and assigned where
the cell's members are.  Exact copies are searched once.  A cell that grows hot (many near vectors) is cut into
blocks of vectors and of queries, so no task holds it whole.  Every vector is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.persist import written

BLOCK = 4096
QUERIES = 32768
#: Cells of the first level, and how many of them a query is followed into where there is a second one.
MOST_CELLS, FOLLOWED = 2500, 8
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.2


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id bigint, x binary: float32 of unit length, h binary: the same for equal directions to six digits) of the vectors with `dim` finite numbers that are not all zero."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.array_contains(F.transform("v", lambda e: e.isNull()), True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, dim))
            most = np.abs(x).max(1)
            good = np.isfinite(most) & (most > 0)  # a NaN anywhere makes the maximum one
            x = x[good] / most[good, None]  # no overflow in squares
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            alike = np.round(x.astype(np.float64), 6) + 0.0
            yield pd.DataFrame({"id": b["id"].to_numpy()[good], "x": pd.Series([r.tobytes() for r in x], dtype=object), "h": pd.Series([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in alike], dtype=object)})

    return rows.mapInPandas(run, "id bigint, x binary, h binary")


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        kept = np.bincount(near, minlength=k) > 0
        c[kept] = sums[kept]
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest centres of each row, the nearest first."""
    out = []
    for at in range(0, len(x), 2048):
        s = x[at : at + 2048] @ c.T
        top = np.argpartition(-s, min(n, s.shape[1]) - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), int)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dim)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
    return np.ascontiguousarray(packed).view(np.uint64)


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of x around its centre: (words, length of the rest, inner product of the code with the rest's direction)."""
    rest = (x - centre) @ turn
    length = np.linalg.norm(rest, axis=1)
    agree = np.abs(rest).sum(1) / (np.sqrt(x.shape[1]) * np.maximum(length, 1e-12))
    return pack(rest > 0), length, np.maximum(agree, 1e-3)


def estimate(q: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rotated queries with codes of +-1/sqrt(dim), by population counts of 4-bit planes; and each query's quantisation error at most."""
    dim = q.shape[1]
    low, high = q.min(1, keepdims=True), q.max(1, keepdims=True)
    step = np.maximum((high - low) / 15, 1e-12)
    levels = np.rint((q - low) / step).astype(np.uint8)
    total = np.zeros((len(q), len(words)), np.int32)
    for j in range(4):
        plane = pack((levels >> j) & 1)
        for w in range(words.shape[1]):
            total += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.int32) << j
    ones = np.bitwise_count(words).sum(1, dtype=np.int32)
    low, step = low.astype(np.float32), step.astype(np.float32)
    whole = low * dim + step * levels.sum(1, keepdims=True, dtype=np.int32).astype(np.float32)
    ip = (2 * (low * ones[None, :].astype(np.float32) + step * total.astype(np.float32)) - whole) * np.float32(1 / np.sqrt(dim))
    return ip, step[:, 0] / 2


def _flat(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of float32 bytes as a matrix, without copying."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offsets = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)
    start = int(offsets[a.offset])
    return np.frombuffer(a.buffers()[2], np.uint8)[start : start + len(a) * dim * 4].view(np.float32).reshape(-1, dim)


def _search(qid: np.ndarray, q: np.ndarray, did: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many, ids, cosines): for each query its k best among x, itself aside, one query after the other: bounds from codes, then exact scores."""
    dim = x.shape[1]
    words, length, agree = codes(x, centre, turn)
    spread = (length * np.sqrt(np.maximum(1 - agree**2, 0)) / agree * EPSILON / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    scale = (length / agree).astype(np.float32)
    sizes, ids, cos = [], [], []
    for at in range(0, len(q), 256):
        part, own = q[at : at + 256], qid[at : at + 256]
        turned = part @ turn
        ip, coarse = estimate(turned, words)
        base = part @ centre
        guess = base[:, None].astype(np.float32) + scale[None, :] * ip
        wide = spread[None, :] + scale[None, :] * coarse[:, None]
        low = guess - wide
        same = own[:, None] == did[None, :]
        low[same] = -9
        cut = np.partition(low, len(did) - k, axis=1)[:, len(did) - k] if len(did) > k else np.full(len(part), -8.0)
        keep = (guess + wide >= cut[:, None]) & ~same
        # few survivors are scored one by one; many (short vectors, wide bounds) by one product for the block
        if keep.mean() < 0.05:
            r, c = np.nonzero(keep)
            score = np.full(keep.shape, -9, np.float32)
            score[r, c] = np.einsum("ij,ij->i", part[r], x[c])
        else:
            score = part @ x.T
            score[~keep] = -9
        most = min(k + 3, len(did))
        top = np.argpartition(-score, most - 1, axis=1)[:, :most]
        valid = np.take_along_axis(score, top, 1) > -8
        exact = np.einsum("ij,ikj->ik", part, x[top], dtype=np.float64)
        exact[~valid] = -9
        order = np.lexsort((did[top], -exact), axis=1)[:, :k]
        near, value = np.take_along_axis(did[top], order, 1), np.take_along_axis(exact, order, 1)
        size = np.minimum(valid.sum(1), k)
        held = np.arange(near.shape[1])[None, :] < size[:, None]
        sizes.append(size)
        ids.append(near[held])
        cos.append(value[held])
    return np.concatenate(sizes), np.concatenate(ids), np.concatenate(cos)


def _parts(cell: Column, counted: DataFrame, limit: int, name: str) -> DataFrame:
    """(cell, name): in how many blocks of `limit` rows a hot cell is cut. Cells within the limit have no row, so the table is small."""
    return counted.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("cell", F.ceil(F.col("n") / limit).cast("int").alias(name))


def _inner_cells(placed: DataFrame, dim: int, probes: int, per_cell: int, sample: int, seed: int) -> DataFrame:
    """`placed` with cells inside the first level's cells: home first, then the nearest others.

    Each first cell gets a centre for every `per_cell` of its members, fitted on a share of them drawn by hash; a vector is compared with
    the inner centres of its FOLLOWED nearest first cells, in blocks.
    """
    home = F.col("cells")[0]
    sizes = placed.groupBy(home.alias("cell")).agg(F.count("*").alias("n"))  # MOST_CELLS rows at most
    sizes = sizes.withColumn("s", F.ceil(F.col("n") / per_cell).cast("int")).withColumn("share", F.least(F.lit(1.0), F.least(24 * F.col("s"), F.lit(sample)) / F.col("n")))
    drawn = placed.select("id", "x", home.alias("cell")).join(F.broadcast(sizes), "cell").where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group["x"], dim)
        c = centres(x, int(max(1, min(group["s"].iloc[0], len(x) // 8))), seed)
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "c": [c.astype(np.float32).tobytes()]})

    inner = written(drawn.select("cell", "x", "s").groupBy("cell").applyInPandas(fit, "cell int, c binary"))
    asks = placed.select("id", "x", F.posexplode(F.slice("cells", 1, FOLLOWED)).alias("pos", "cell"))
    parts = F.broadcast(_parts(F.col("cell"), asks, QUERIES, "parts"))
    asks = asks.join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    held = inner.join(parts, "cell", "left").select(F.col("cell").alias("icell"), "c", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("ipart"))

    def follow(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "x": pd.Series([], dtype=object), "near": pd.Series([], dtype=object)})
        c, x = np.frombuffer(right["c"].iloc[0], np.float32).reshape(-1, dim), _matrix(left["x"], dim)
        top = nearest(x, c, min(probes, len(c)))
        base = int(left["cell"].iloc[0]) << 20
        near = [[(float(-v @ c[j]), base + int(j)) for j in t] for v, t in zip(x, top, strict=True)]
        return pd.DataFrame({"id": left["id"], "x": [b if p == 0 else None for b, p in zip(left["x"], left["pos"], strict=True)], "near": pd.Series(near, dtype=object)})

    near = asks.select("id", "x", "pos", "cell", "part").groupBy("cell", "part").cogroup(held.groupBy("icell", "ipart")).applyInPandas(follow, "id bigint, x binary, near array<struct<far: double, cell: bigint>>")
    best = near.groupBy("id").agg(F.max("x").alias("x"), F.max(F.when(F.col("x").isNotNull(), F.struct("id", "near"))).alias("h"), F.flatten(F.collect_list("near")).alias("all"))  # FOLLOWED x probes at most
    order = F.transform(F.slice(F.array_sort("all"), 1, probes), lambda s: s["cell"])
    return written(best.select("id", "x", F.slice(F.array_distinct(F.concat(F.array(F.col("h.near")[0]["cell"]), order)), 1, probes).alias("cells")))


def _search_all(reps: DataFrame, dim: int, k: int, probes: int, per_cell: int, sample: int, seed: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, near array<bigint>, cos array<double>): for each rep (id, x), its k best among the other reps."""
    spark = reps.sparkSession
    rows = reps.count()
    drawn = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").toPandas()["x"]
    cells = int(max(1, min(rows // per_cell, len(drawn) // 8, most_cells)))
    fit = _matrix(drawn, dim) if len(drawn) else np.zeros((1, dim), np.float32)
    c = centres(fit, cells, seed)
    turn = rotation(dim, seed)
    shared = spark.sparkContext.broadcast((c, turn))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = shared.value
        for b in batches:
            near = nearest(_matrix(b["x"], dim), own, min(probes, len(own)))
            yield b[["id", "x"]].assign(cells=pd.Series(list(near.astype(np.int32)), dtype=object, index=b.index))

    placed = written(reps.mapInPandas(assign, "id bigint, x binary, cells array<int>"))
    if rows // per_cell > 2 * cells:
        placed = _inner_cells(placed, dim, probes, per_cell, sample, seed)
    data = placed.select("id", "x", F.col("cells")[0].alias("cell"))
    asks = placed.select("id", "x", F.explode("cells").alias("cell"))
    hot_data, hot_asks = F.broadcast(_parts(F.col("cell"), data, BLOCK, "db")), F.broadcast(_parts(F.col("cell"), asks, QUERIES, "qb"))  # one row a hot cell
    db, qb = F.coalesce("db", F.lit(1)), F.coalesce("qb", F.lit(1))
    data = data.join(hot_data, "cell", "left").join(hot_asks, "cell", "left").select("id", "x", "cell", F.pmod(F.xxhash64("id"), db).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), qb - 1)).alias("q"))
    asks = asks.join(hot_data, "cell", "left").join(hot_asks, "cell", "left").select("id", "x", "cell", F.explode(F.sequence(F.lit(0), db - 1)).alias("d"), F.pmod(F.xxhash64("id"), qb).cast("int").alias("q"))

    form = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("cos", pa.list_(pa.float64()))])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return form.empty_table()
        _, t = shared.value
        x = _flat(right["y"], dim)
        sizes, near, cos = _search(left["id"].to_numpy(), _flat(left["x"], dim), right["did"].to_numpy(), x, x.mean(0), t, k)
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.table([left["id"].combine_chunks(), pa.ListArray.from_arrays(ends, pa.array(near, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(cos, pa.float64()))], schema=form)

    data = data.toDF("did", "y", "dcell", "dd", "dq")
    found = asks.groupBy("cell", "d", "q").cogroup(data.groupBy("dcell", "dd", "dq")).applyInArrow(scan, "id bigint, near array<bigint>, cos array<double>")
    best = found.where(F.size("near") > 0).groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("cos", "near"))).alias("all"))  # at most k a cell visited
    best = best.select("id", F.slice(F.array_sort(F.transform("all", lambda s: F.struct((-s["cos"]).alias("far"), s["near"].alias("near")))), 1, k).alias("top"))
    return best.select("id", F.col("top.near").alias("near"), F.transform("top", lambda s: -s["far"]).alias("cos"))


def most_similar(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, probes: int = 20, per_cell: int = 400, sample: int = 20_000, seed: int = 5, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id bigint, near bigint, cos double, rank int): for each usable vector its k most similar others.

    Ties go to the smaller id, so copies are neighbours of one another by id.  Null, empty, all-zero, not finite
    and wrongly long vectors take no part, nor do null keys; a vector's length does not matter; keys must be unique bigints.
    With fewer than k others a vector has as many neighbours as there are; an empty table gives no row.
    """
    vectors = written(usable(df, key, vector, dim))
    firsts = vectors.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = written(firsts.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("x", "id").alias("x")))  # at most k + 1 ids
    reps = groups.select(F.col("ids")[0].alias("id"), "x")
    found = _search_all(reps, dim, k, probes, per_cell, sample, seed, most_cells)
    lists = groups.select(F.col("ids")[0].alias("rep"), "ids", "h")
    pairs = found.select("id", F.posexplode(F.arrays_zip("near", "cos")).alias("p", "s")).select("id", F.col("s.near").alias("rep"), F.col("s.cos").alias("cos"))
    # neighbours of a rep: members of the neighbouring groups, each group at most k + 1
    around = pairs.join(lists.select("rep", "ids"), "rep").select(F.col("id").alias("rep"), "cos", F.explode("ids").alias("near"))
    around = around.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), "near"))), 1, k).alias("around"))
    whole = lists.join(around, "rep", "left").select("h", "ids", F.coalesce("around", F.array().cast("array<struct<far:double,near:bigint>>")).alias("around"))
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("near")))
    out = vectors.select("id", "h").join(whole, "h").select("id", F.slice(F.concat(own, "around"), 1, k).alias("top"))
    return out.select("id", F.posexplode("top").alias("p", "s")).select("id", F.col("s.near").alias("near"), (-F.col("s.far")).alias("cos"), (F.col("p") + 1).alias("rank"))


def exact_neighbours(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64) -> DataFrame:
    """The same columns as `most_similar` for a stated query set (rows of `df`), by brute force in blocks: to measure recall.

    The query set goes to the executors in blocks of at most 8,192, so it may be of any size.
    """
    q = usable(queries, key, vector, dim).select("id", "x")
    x = usable(df, key, vector, dim).select("id", "x")
    n = q.count()
    asks = q.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // 8192)))).cast("int"))
    parts = max(1, x.sparkSession.sparkContext.defaultParallelism * 2)
    sides = x.withColumn("d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // 8192)) - 1))))
    asks = asks.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "near": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype="float64")})
        a, b = _matrix(left["x"], dim), _matrix(right["w"], dim)
        ids, found = right["did"].to_numpy(), []
        for at in range(0, len(a), 512):
            s = a[at : at + 512] @ b.T
            own = left["id"].to_numpy()[at : at + 512]
            s[own[:, None] == ids[None, :]] = -9
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
            for i, t in enumerate(top):
                found += [(own[i], ids[j], float(np.dot(a[at + i].astype(np.float64), b[j].astype(np.float64)))) for j in t if s[i, j] > -8]
        return pd.DataFrame(found, columns=["id", "near", "cos"])

    sides = sides.toDF("did", "w", "sd", "sb")
    near = asks.groupBy("b", "d").cogroup(sides.groupBy("sb", "sd")).applyInPandas(scan, "id bigint, near bigint, cos double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cos", 6)), "near"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
