"""Splits that keep related records together.

Method: grouped iterative stratification.  Records are tied to entities (a company, a passage); connected
components of the graph of entities become indivisible groups; each group's label counts are summed; groups
are placed, those with the rarest outstanding label first and the largest first within it, into the split
that needs that label most.

Scale: components are found on the graph of entities, never of records, by min-label propagation with
pointer jumping and reliable checkpoints; hub entities are joined, not collected (their joins are many rows to one, which
the adaptive planner splits).  Placement is sequential by nature, so it runs on the groups of equal shape: groups with
the same label counts are one row with a count, and are dealt out together in closed form.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.persist import cut, written

BINS = 4096
SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def passage_key(text):
    """Key of a passage: letters and digits in lower case, marks, leading tags and item headings aside. Null for null and blank."""
    c = F.lower(F.regexp_replace(F.regexp_replace(text, r"<[^>]{0,200}>", " "), r"&#?\w{1,8};", " "))
    head = (
        r"^[\s\p{Punct}\p{Cf}]*(?:\[[^\]]{0,40}\]|\((?:continued|cont\.?|excerpt|extract|unaudited|source[^)]{0,12}|passage[^)]{0,12})\)"
        r"|(?:part\s+[iv]+\b[\s\p{Punct}]*)?item\s+\d{1,2}\s?[a-c]?\b(?:\s*[.:\-–—|]+\s*(?:risk factors|business|financial statements[a-z ]{0,30}|management.s discussion[a-z' ]{0,90})\s*[.:\-–—|]+)?"
        r"|(?:passage|context|source|excerpt|extract)\s*\d{0,3}\s*[:\-–—\]|.])[\s\p{Punct}]*"
    )
    for _ in range(3):
        c = F.regexp_replace(c, head, "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return F.when(c != "", F.concat(F.md5(c), F.lit("-"), F.length(c)))


def ticker_form(ticker):
    """A ticker in upper case without spaces and exchange prefix; null for null and blank."""
    c = F.upper(F.regexp_replace(F.regexp_replace(ticker, r"(?U)[\s\p{Cf}]+", ""), r"^[^:]*:", ""))
    return F.when(c != "", F.regexp_replace(c, r"^\$", ""))


def company_of(df: DataFrame, companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Adds form (the ticker's form) and company (the ticker of its row in `companies`, by ticker or former_ticker; null if none).

    A form that is one company's ticker and another's former ticker leads to the first. `companies` is joined by shuffle or broadcast as its size allows.
    """
    now = companies.select(ticker_form(F.col("ticker")).alias("form"), F.col("ticker").alias("company"), F.lit(0).alias("old"))
    past = companies.select(ticker_form(F.col("former_ticker")).alias("form"), F.col("ticker").alias("company"), F.lit(1).alias("old"))
    names = now.unionByName(past).where("form is not null").groupBy("form").agg(F.min_by("company", F.struct("old", "company")).alias("company"))
    return df.withColumn("form", ticker_form(F.col(ticker))).join(names, "form", "left")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b). Null ends are dropped.

    Min-label propagation with a pointer jump in every round, so a chain of n nodes needs about log n rounds; the label table is
    checkpointed in each. Raises RuntimeError if most_rounds do not suffice. Isolated nodes may come as a = b.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        heard = e.join(labels.select(F.col("node").alias("b"), "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("h"))
        # a root's new parent is the least label its members heard; all members follow it
        moved = labels.join(heard, "node").select("node", "l", F.least("l", "h").alias("n"))
        parent = moved.groupBy("l").agg(F.min("n").alias("p"))
        jumped = moved.join(parent, "l").select("node", "l", F.least("n", "p").alias("n"))
        further = jumped.join(parent.select(F.col("l").alias("n"), F.col("p").alias("pp")), "n", "left").select("node", "l", F.least("n", F.coalesce("pp", "n")).alias("n"))
        new = cut(further)
        if new.where("l <> n").isEmpty():
            return new.select("node", F.col("n").alias("component"))
        labels = new.select("node", F.col("n").alias("l"))
    raise RuntimeError("components did not settle")


def group_records(df: DataFrame, companies: DataFrame, key: str = "qa_id", ticker: str = "ticker", context: str = "context") -> DataFrame:
    """(key, company, passage, component) for every record.

    Records are tied by the same company, the same unknown ticker or the same passage, directly or through others.
    A record with neither is a component of its own. Null and blank tickers and contexts tie nothing.
    """
    rows = df.select(F.col(key).alias("key"), F.col(ticker).alias("ticker"), passage_key(F.col(context)).alias("passage"))
    rows = company_of(rows, companies).select("key", "company", "passage", F.coalesce(F.concat(F.lit("c:"), "company"), F.concat(F.lit("t:"), "form")).alias("who"))
    rows = written(rows)
    what = F.concat(F.lit("p:"), "passage")
    edges = rows.select(F.coalesce("who", what).alias("a"), F.coalesce(what, "who").alias("b")).where("a is not null").distinct()
    label = components(edges)
    node = F.coalesce("who", what, F.concat(F.lit("r:"), F.col("key").cast("string")))
    out = rows.withColumn("node", node).join(label, "node", "left")
    return out.select(F.col("key").alias(key), "company", "passage", F.coalesce("component", "node").alias("component"))


def same_passage_apart(grouped: DataFrame, key: str = "qa_id", block: int = 1000) -> DataFrame:
    """Distinct pairs (a, b), a < b, of records with the same passage whose tickers do not lead to the same company.

    `grouped` comes from `group_records`. Such a pair lies inside one component, so the work is keyed by component and passage; passages
    all of whose records lead to one company are set aside first. Records of one passage and company are a class, kept as blocks of at
    most `block` keys; blocks are paired, then spread over the tasks and written out, so a passage that a third of all records share is no single task.
    Repeated keys make one pair; null keys and passages none.
    """
    rows = grouped.select(F.col(key).alias("k"), "company", "passage", "component").where("passage is not null and k is not null")

    sides = rows.groupBy("component", "passage").agg(F.min("company").alias("lo"), F.max("company").alias("hi"), F.count_if(F.col("company").isNull()).alias("none"), F.count("*").alias("n"))
    mixed = sides.where("n > 1 and (none > 0 or lo <> hi)").select("component", "passage")
    rows = written(rows.join(mixed, ["component", "passage"], "left_semi"))
    sizes = rows.groupBy("component", "passage", "company").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).toDF("c2", "p2", "w2", "parts")
    same = (F.col("component") == F.col("c2")) & (F.col("passage") == F.col("p2")) & F.col("company").eqNullSafe(F.col("w2"))
    parted = rows.join(sizes, same).select("component", "passage", "company", "k", F.pmod(F.xxhash64("k"), F.col("parts")).alias("part"))
    blocks = written(parted.groupBy("component", "passage", "company", "part").agg(F.collect_set("k").alias("ks")))  # about `block` keys
    names = ["company", "part", "ks"]
    left = blocks.select("component", "passage", *(F.col(c).alias(f"{c}_a") for c in names))
    right = blocks.select("component", "passage", *(F.col(c).alias(f"{c}_b") for c in names))
    first, second = (F.struct(F.coalesce(F.col(f"company_{x}"), F.lit("")), F.col(f"part_{x}")) for x in "ab")
    apart = ~F.coalesce(F.col("company_a") == F.col("company_b"), F.lit(False))
    met = left.join(right, ["component", "passage"]).where((first <= second) & apart).select("ks_a", "ks_b")
    spread = met.repartition(F.xxhash64("ks_a", "ks_b")).select(F.explode("ks_a").alias("x"), "ks_b").select("x", F.explode("ks_b").alias("y"))
    return spread.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _fill(needs: dict[str, float], step: float, n: int) -> dict[str, int]:
    """Of n alike groups that each meet `step` of a need, how many go to each split if each goes to the neediest: by water filling, not one by one."""
    order = sorted(needs, key=lambda s: (-needs[s], s))
    for m in range(1, len(order) + 1):
        level = (sum(needs[s] for s in order[:m]) - n * step) / m
        if m == len(order) or level >= needs[order[m]]:
            break
    give = {s: max(0, math.floor((needs[s] - level) / step + 1e-9)) for s in order[:m]}
    while (left := n - sum(give.values())) != 0:  # at most as many steps as splits
        after = {s: needs[s] - give[s] * step for s in give}
        if left > 0:
            give[max(after, key=lambda s: (after[s], s))] += 1
        else:
            give[min((s for s in give if give[s]), key=lambda s: (after[s], s))] -= 1
    return give


def _deal(shapes: list[tuple], labels: list[str], wanted: dict[str, dict[str, float]]) -> list[tuple[str, str, int]]:
    """Iterative stratification over (shape, groups of this shape, counts by label): (shape, split, groups placed there)."""
    out: list[tuple[str, str, int]] = []
    left = {i: (n, dict(zip(labels, counts, strict=True))) for i, n, counts in shapes}
    having = {x: {i for i, (_, c) in left.items() if c[x] > 0} for x in labels}
    outstanding = {x: sum(left[i][0] * left[i][1][x] for i in having[x]) for x in labels}
    while left:
        rare = min((x for x in labels if having[x]), key=lambda x: (outstanding[x], x))
        for i in sorted(having[rare], key=lambda i: (-sum(left[i][1].values()), i)):
            n, counts = left.pop(i)
            for split, k in _fill({s: w[rare] for s, w in wanted.items()}, counts[rare], n).items():
                for x in labels:
                    wanted[split][x] -= k * counts[x]
                if k:
                    out.append((i, split, k))
            for x in labels:
                outstanding[x] -= n * counts[x]
                having[x].discard(i)
    return out


def stratified_split(grouped: DataFrame, labels: DataFrame, key: str = "qa_id", splits: tuple = SPLITS, most_labels: int = 64, most_shapes: int = 20_000) -> DataFrame:
    """(key, component, split) for every record of `grouped`; no component is parted and no record left out.

    `labels` has key and label (null, and a record without a row, are a label too). Labels beyond the `most_labels` most frequent ones
    are balanced together, as one. To the driver goes one row for each distinct vector of label counts, never one for each group or
    record; the `most_shapes` heaviest vectors stand for themselves, all lighter groups are dealt out together by their rarest label, with
    the mean of their counts. A component larger than a split's share goes to train. Ties fall by the hash of the component, so
    the result is stable.
    """
    label = F.coalesce(F.col("label").cast("string"), F.lit("none"))
    tagged = grouped.select(key, "component").join(labels.select(key, F.col("label")).dropDuplicates([key]), key, "left").select("component", label.alias("l"))
    frequent = [r["l"] for r in tagged.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_labels + 1).collect()]
    kept = sorted(frequent[:most_labels]) or ["none"]
    names = kept + (["\0rest"] if len(frequent) > most_labels else [])
    counts = [F.count_if(F.col("l") == x) for x in kept] + ([F.count_if(~F.col("l").isin(kept))] if len(names) > len(kept) else [])
    sizes = tagged.groupBy("component").agg(*(c.alias(f"n{k}") for k, c in enumerate(counts)))
    vector = F.array(*(F.col(f"n{k}") for k in range(len(names))))
    sizes = sizes.select("component", vector.alias("counts")).withColumn("own", F.concat_ws(",", F.col("counts").cast("array<string>")))
    sizes = written(sizes.withColumn("weight", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    heavy = sizes.groupBy("own").agg(F.first("weight").alias("w")).orderBy(F.desc("w"), "own").limit(most_shapes).select("own", F.lit(True).alias("heavy"))
    order = sizes.agg(*(F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(len(names)))).first()
    rarity = sorted(range(len(names)), key=lambda k: (order[k] or 0, names[k]))
    rarest = F.coalesce(*(F.when(F.col("counts")[k] > 0, F.lit(f"~{k}")) for k in rarity), F.lit("~"))
    sizes = written(sizes.join(F.broadcast(heavy), "own", "left").select("component", "counts", F.when(F.col("heavy"), F.col("own")).otherwise(rarest).alias("shape")))  # at most `most_shapes`
    means = [F.avg(F.col("counts")[k]).alias(f"n{k}") for k in range(len(names))]
    rows = [{"shape": r["shape"], "n": r["n"], "counts": list(r[2:])} for r in sizes.groupBy("shape").agg(F.count("*").alias("n"), *means).collect()]
    whole = [sum(r["n"] * r["counts"][k] for r in rows) for k in range(len(names))]
    wanted = {s: {x: share * whole[k] for k, x in enumerate(names)} for s, share in splits}
    dealt = _deal([(r["shape"], r["n"], r["counts"]) for r in rows], names, wanted)
    spark = grouped.sparkSession
    plan, at = [], {}
    for shape, split, n in dealt:
        plan.append((shape, split, at.get(shape, 0), at.get(shape, 0) + n))
        at[shape] = at.get(shape, 0) + n
    table = spark.createDataFrame(plan, "shape string, split string, lo bigint, hi bigint")
    # ranks inside a shape: by bins of a hash, so that a shape with very many groups is no single task
    binned = sizes.select("component", "shape", F.pmod(F.xxhash64("component"), F.lit(BINS)).alias("bin"))
    bins = binned.groupBy("shape", "bin").agg(F.count("*").alias("c"))
    starts = bins.select("shape", "bin", (F.sum("c").over(Window.partitionBy("shape").orderBy("bin")) - F.col("c")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shape", "bin").orderBy(F.xxhash64("component", F.lit(1)), "component")) - 1
    ranked = binned.join(starts, ["shape", "bin"]).select("component", "shape", (F.col("start") + inside).alias("rank"))
    placed = ranked.join(table, (ranked["shape"] == table["shape"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("component", "split")
    return grouped.select(key, "component").join(placed, "component").select(key, "component", "split")


def split_shares(split: DataFrame, splits: tuple = SPLITS) -> DataFrame:
    """One row per split: split, target, records, groups, share."""
    targets = split.sparkSession.createDataFrame(list(splits), "split string, target double")
    sums = split.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("component").alias("groups"))
    whole = F.sum("records").over(Window.partitionBy())  # as many rows as splits
    return targets.join(sums, "split", "left").select("split", "target", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce(F.round(F.col("records") / whole, 6), F.lit(0.0)).alias("share"))
