"""Retrieval quality: first relevant rank, hit rates, reciprocal rank, breakdowns and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import canonical_sections, metric_key


def convert_benchmark(questions: DataFrame) -> DataFrame:
    """Benchmark rows with expected_ticker, expected_sections (array) and the main expected_section."""
    items = canonical_sections(F.col("source_section"))
    return questions.select(F.col("item_id").alias("qid"), F.col("question").alias("query"), F.col("source_company").alias("expected_ticker"), items.alias("expected_sections"), items[0].alias("expected_section"), "answer_type", "difficulty", "fiscal_year", "gold_answer", F.col("source_section").alias("raw_source_section"))


def judge(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(…question columns, match_rank, reciprocal_rank, top_sections) for every question, misses with a null rank and 0.

    `hits` has qid, rank, ticker, section; a hit is relevant if its ticker is the expected one and its section among the expected.
    """
    rows = hits.select("qid", "rank", "ticker", "section")
    top = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "ticker", "section").alias("s")))), lambda x: x["s"]).alias("top_sections"))
    good = rows.join(questions.select("qid", "expected_ticker", "expected_sections"), "qid").where((F.col("ticker") == F.col("expected_ticker")) & F.array_contains("expected_sections", F.col("section")))
    best = good.groupBy("qid").agg(F.min("rank").alias("match_rank"))
    return questions.join(best, "qid", "left").join(top, "qid", "left").withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("match_rank"), F.lit(0.0)))


def _rates() -> list:
    return [F.round(F.avg(F.when(F.col("match_rank") <= n, 1.0).otherwise(0.0)) * 100, 6).alias(f"hit_rate_at_{n}") for n in (1, 3, 5)] + [F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count("*").alias("total_queries")]


def metrics(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rates in percent, mean reciprocal rank and number of queries, over all or by group."""
    return judged.groupBy(*(by or [])).agg(*_rates())


def breakdowns(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(slice, value, count, hr1, hr5, mrr): the breakdowns by several keys in one pass, by grouping sets."""
    sets = [[F.col(k)] for k in keys]
    value = F.coalesce(*(F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in keys))
    name = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))
    hr = [F.round(F.avg(F.when(F.col("match_rank") <= n, 1.0).otherwise(0.0)) * 100, 6).alias(f"hr{n}") for n in (1, 5)]
    return judged.groupingSets(sets, *keys).agg(name.alias("slice"), value.alias("value"), F.count("*").alias("count"), *hr, F.round(F.avg("reciprocal_rank"), 6).alias("mrr")).select("slice", "value", "count", "hr1", "hr5", "mrr")


def metric_rows(run: str, whole: DataFrame, by_type: DataFrame | None = None, by_company: DataFrame | None = None) -> DataFrame:
    """(run, key, value) rows for a tracking table: the four main metrics, and hr5 and mrr of each group (value, hr5, mrr)."""
    out = whole.unpivot([], ["hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5", "mrr"], "key", "value")
    for part, kind in ((by_type, "type"), (by_company, "co")):
        if part is not None:
            long = part.unpivot(["value"], ["hr5", "mrr"], "m", "v")
            out = out.unionByName(long.select(F.concat(F.lit(f"{kind}_"), metric_key(F.col("value"), kind), F.lit("_"), F.col("m")).alias("key"), F.coalesce("v", F.lit(0.0)).alias("value")))
    return out.select(F.lit(run).alias("run"), "key", "value")


def replayed(results: DataFrame, run: str, metrics_key: str, type_key: str | None = None, company_key: str | None = None) -> DataFrame:
    """(run, key, value) from the JSON of a result file (column json): the run's metrics, and its breakdowns with hr5, or hr1 where that is missing.

    The file may wrap its metrics in "summary". A file without the metrics raises.
    """
    m = F.coalesce(F.get_json_object("json", f"$.summary.{metrics_key}"), F.get_json_object("json", f"$.{metrics_key}"))
    found = F.from_json(F.when(m.isNull(), F.raise_error(F.lit(f"no {metrics_key} in the results")).cast("string")).otherwise(m), "map<string,double>")
    names = F.array(*map(F.lit, ("hit_rate_at_1", "hit_rate_at_3", "hit_rate_at_5", "mrr")))
    out = results.select(F.explode(F.transform(names, lambda n: F.struct(n.alias("key"), F.coalesce(F.try_element_at(found, n), F.lit(0.0)).alias("value")))).alias("x")).select("x.*")
    for key, kind in ((type_key, "type"), (company_key, "co")):
        if key:
            groups = results.select(F.explode(F.from_json(F.get_json_object("json", f"$.{key}"), "map<string,map<string,double>>")).alias("g", "s"))
            hr5 = F.coalesce(F.try_element_at("s", F.lit("hr5")), F.try_element_at("s", F.lit("hr1")), F.lit(0.0))
            name = F.concat(F.lit(f"{kind}_"), metric_key(F.col("g"), kind))
            pair = F.array(F.struct(F.concat(name, F.lit("_hr5")).alias("key"), hr5.alias("value")), F.struct(F.concat(name, F.lit("_mrr")).alias("key"), F.coalesce(F.try_element_at("s", F.lit("mrr")), F.lit(0.0)).alias("value")))
            out = out.unionByName(groups.select(F.explode(pair).alias("x")).select("x.*"))
    return out.select(F.lit(run).alias("run"), "key", "value")


def deltas(rows: DataFrame, base: str) -> DataFrame:
    """(run, key, value, base_value, delta) against the run `base`; a key that the base lacks counts as 0 there."""
    b = rows.where(F.col("run") == base).select("key", F.col("value").alias("base_value"))
    return rows.join(b, "key", "left").select("run", "key", "value", F.coalesce("base_value", F.lit(0.0)).alias("base_value"), F.round(F.col("value") - F.coalesce("base_value", F.lit(0.0)), 6).alias("delta"))


def comparison(rows: DataFrame, runs: list[str]) -> DataFrame:
    """A table of metrics, one row for each key and a column for each run, with the last run's gain over the first (null where one has none)."""
    wide = rows.where(F.col("run").isin(runs)).groupBy("key").pivot("run", runs).agg(F.first("value"))
    return wide.withColumn("gain", F.round(F.col(f"`{runs[-1]}`") - F.col(f"`{runs[0]}`"), 6))


def printed(table: DataFrame, width: int = 14) -> DataFrame:
    """(line) of a comparison table as text of fixed width, the name to the left, numbers with four digits to the right."""
    first, *others = table.columns
    cells = [F.lpad(F.coalesce(F.format_string("%.4f", F.col(f"`{c}`").cast("double")), F.lit("-")), width, " ") for c in others]
    return table.select(F.concat(F.rpad(F.col(f"`{first}`"), 2 * width, " "), *cells).alias("line"))


def progress(judged: DataFrame, every: int = 20) -> DataFrame:
    """(n, hr1, mrr) running over the questions in order of qid, at each multiple of `every` and at the end. A question set is small; it is one window."""
    upto = Window.orderBy("qid").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged.select(F.row_number().over(Window.orderBy("qid")).alias("n"), F.round(F.avg(F.when(F.col("match_rank") <= 1, 100.0).otherwise(0.0)).over(upto), 6).alias("hr1"), F.round(F.avg("reciprocal_rank").over(upto), 6).alias("mrr"), F.count("*").over(Window.partitionBy()).alias("all"))
    return rows.where((F.col("n") % every == 0) | (F.col("n") == F.col("all"))).drop("all")


def report(run: str, whole: DataFrame, sliced: DataFrame, judged: DataFrame) -> DataFrame:
    """One row with the whole report as JSON: summary, breakdowns, details of each question."""
    s = whole.agg(F.first(F.struct("*")).alias("summary"))
    b = sliced.agg(F.array_sort(F.collect_list(F.struct("slice", "value", "count", "hr1", "hr5", "mrr"))).alias("breakdowns"))
    d = judged.agg(F.array_sort(F.collect_list(F.struct("qid", "query", "match_rank", "reciprocal_rank", "top_sections"))).alias("details"))
    return s.crossJoin(b).crossJoin(d).select(F.lit(run).alias("run"), F.to_json(F.struct("summary", "breakdowns", "details")).alias("report"))  # one row each
