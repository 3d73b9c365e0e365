"""Registered queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import prompts, text
from ledgerloom.operators import answer, bm25, chunking, dataset, dense, embed, evaluate, fusion, heldout, html, search, service, transformer
from ledgerloom.operators.units import extract_measures, resolve_units
from ledgerloom.plans.persist import shared_folder, written
from ledgerloom.sources import filings, sinks
from ledgerloom.sources.tables import table
from ledgerloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL

_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), ' ')"


#: Letters and numbers outside ASCII.
_WIDE = r"(?:[^\x00-\x7F\PL]|[^\x00-\x7F\PN])"


def _tokens(x: str) -> str:
    """Tokens between word boundaries of Unicode: words with letters outside ASCII become a mark that bounds like a word, and tokens are cut at the mark."""
    marked = f"regexp_replace(lower({x}), '\\w*{_WIDE}(?:\\w|{_WIDE})*', 'qqzq', 'g')"
    found = f"flatten(list_transform(regexp_extract_all({marked}, '\\b[A-Za-z0-9_$%.-]+\\b'), lambda t: string_split(t, 'qqzq')))"
    return f"list_filter(list_transform({found}, lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')), lambda t: t <> '')"


_SECTION = "CASE WHEN contains(lower(section), '1a') OR contains(lower(section), 'risk') THEN 'item_1a' WHEN contains(lower(section), '7') THEN 'item_7' WHEN contains(lower(section), '8') THEN 'item_8' WHEN contains(lower(section), '1') THEN 'item_1' ELSE 'unknown' END"
_CORPUS = f"""corpus AS (
  SELECT chunk_id, text, upper({_strip("ticker")}) AS ticker, fiscal_year, {_SECTION} AS section, greatest(1, length(text) // 4) AS token_count_est
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, parsed_at DESC NULLS LAST, chunk_index DESC NULLS LAST) AS n FROM chunks)
  WHERE n = 1 AND text IS NOT NULL)"""
_BM25 = f"""
  split AS (SELECT chunk_id AS id, {_tokens("text")} AS terms FROM corpus),
  postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM split) GROUP BY ALL),
  lengths AS (SELECT id, len(terms) AS dl FROM split),
  dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
  whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
  raws AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM dfs, whole),
  idfs AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
  asked AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({_tokens("query")}) AS term FROM qs) GROUP BY ALL),
  scored AS (SELECT qid, p.id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idfs USING (term) JOIN postings p USING (term) JOIN lengths USING (id) WHERE p.id IN (SELECT id FROM allowed) GROUP BY ALL),
  filled AS (SELECT * FROM scored UNION ALL SELECT q.qid, s.id, 0.0 FROM (SELECT DISTINCT qid FROM asked) q, (SELECT id FROM allowed ORDER BY id LIMIT 100) s WHERE NOT EXISTS (SELECT 1 FROM scored x WHERE x.qid = q.qid AND x.id = s.id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM filled)"""
_QUESTIONS = "qs AS (SELECT item_id AS qid, question AS query FROM benchmark_questions)"
_FILTER = "allowed AS (SELECT chunk_id AS id FROM corpus WHERE section = 'item_7' AND fiscal_year = 2023)"
_ALL = "allowed AS (SELECT chunk_id AS id FROM corpus)"
_USABLE = "v IS NOT NULL AND len(v) = 64 AND list_aggregate(list_transform(v, lambda x: isfinite(x)), 'bool_and') AND list_aggregate(list_transform(v, lambda x: x <> 0), 'bool_or')"
_VECTORS = f"""vs AS (SELECT vector_id AS id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vector_id, vector::DOUBLE[] AS v FROM chunk_vectors) WHERE {_USABLE}),
  dense AS (SELECT q.id AS qid, x.id, list_inner_product(x.v, q.v) / (x.n * q.n) AS score FROM vs x, vs q WHERE q.id % 50 = 0),
  dranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM dense)"""
_QA = f"SELECT qa_id, {_strip('question')} AS question, {_strip('answer')} AS answer, {_strip('context')} AS context, upper({_strip('ticker')}) AS ticker, TRY_CAST(nullif(regexp_extract(filing, '((?:19|20)\\d{{2}})', 1), '') AS INT) AS fiscal_year FROM financial_qa_10k"
_RECORDS = f"records AS (SELECT * FROM ({_QA}) WHERE coalesce(question, '') <> '' AND coalesce(answer, '') <> '' AND coalesce(context, '') <> '')"


# --- inputs

def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of every chunk, with ticker and section in one spelling."""
    s = F.lower("section")
    item = F.when(F.contains(s, F.lit("1a")) | F.contains(s, F.lit("risk")), "item_1a").when(F.contains(s, F.lit("7")), "item_7").when(F.contains(s, F.lit("8")), "item_8").when(F.contains(s, F.lit("1")), "item_1").otherwise("unknown")
    rows = sinks.latest(table(spark, d, "chunks"), "chunk_id", ["ingested_at", "parsed_at", "chunk_index"]).where("text is not null")
    return rows.select("chunk_id", "text", F.upper(text.strip(F.col("ticker"))).alias("ticker"), "fiscal_year", item.alias("section"), text.estimate_tokens(F.col("text")).alias("token_count_est"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_questions").select(F.col("item_id").alias("qid"), F.col("question").alias("query"))


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    rows = table(spark, d, "chunk_vectors").where(F.size(v) == 64)
    return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One usable vector for each chunk that has any: the one of the least vector_id."""
    return usable_vectors(spark, d).where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by("vector", "vector_id").alias("vector"))


def text_queries(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Queries with text and vector: vectors whose id is divisible by 50, with the text of their chunk. `rows` is the corpus, where it is stored."""
    v = written(usable_vectors(spark, d).where("vector_id % 50 = 0").select(F.col("vector_id").alias("qid"), "chunk_id", "vector"))
    texts = search.picked((corpus(spark, d) if rows is None else rows).select("chunk_id", F.col("text").alias("query")), v.select("chunk_id"))
    return written(v.join(texts, "chunk_id").select("qid", "query", "vector"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return dataset.normalize_records(table(spark, d, "financial_qa_10k"), keep=["qa_id"])


# --- text

@query("SELECT chunk_id, ingested_at, greatest(1, length(text) // 4)::INT AS tokens FROM chunks WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", "ingested_at", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT count(text) AS chunks, round(avg(length(text)), 1) AS avg_chars, min(length(text))::INT AS min_chars, max(length(text))::INT AS max_chars, round(avg(greatest(1, length(text) // 4)), 1) AS avg_tokens, min(greatest(1, length(text) // 4))::INT AS min_tokens, max(greatest(1, length(text) // 4))::INT AS max_tokens FROM chunks")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.statistics(table(spark, d, "chunks"))


@query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, chunk FROM (
  SELECT doc_id, i, {_strip("substring(text, i * 2048 + 1, 2048)")} AS chunk FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 2047) // 2048)::BIGINT)) AS i FROM documents WHERE length(text) > 0)) WHERE chunk <> ''""")
def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents"), "text", ["doc_id"])


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'item 8') THEN 'item_8' WHEN contains(lower(text), 'item 7') THEN 'item_7' WHEN contains(lower(text), 'item 1a') THEN 'item_1a' WHEN contains(lower(text), 'item 1') THEN 'item_1' ELSE 'unknown' END AS section FROM documents")
def section_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.guess_section(F.col("text")).alias("section"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, d, "documents"), "text", ["doc_id"])


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_sections(corpus(spark, d), 800, 120)


@query()
def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    return chunking.compare_strategies(corpus(spark, d), {"a": (1500, 200), "b": (800, 120)})


@query(f"""WITH {_CORPUS}, w AS (SELECT ticker, fiscal_year, string_agg(text, chr(10) ORDER BY chunk_id) FILTER (text <> '') AS text FROM corpus GROUP BY ALL),
  c AS (SELECT ticker, fiscal_year, i, {_strip("substring(text, i * 2048 + 1, 2048)")} AS text FROM (SELECT *, unnest(range(0, ((length(text) + 2047) // 2048)::BIGINT)) AS i FROM w WHERE length(text) > 0))
  SELECT text, ticker, fiscal_year, CASE WHEN contains(lower(text), 'item 8') THEN 'item_8' WHEN contains(lower(text), 'item 7') THEN 'item_7' WHEN contains(lower(text), 'item 1a') THEN 'item_1a' WHEN contains(lower(text), 'item 1') THEN 'item_1' ELSE 'unknown' END AS section, (row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY i) - 1)::INT AS chunk_index FROM c WHERE text <> ''""")
def naive_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).groupBy("ticker", "fiscal_year").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "text")))).alias("sections"))
    return chunking.naive_corpus(rows)


@query(f"SELECT qa_id, {_norm('question')} AS question, {_norm('answer')} AS answer FROM financial_qa_10k")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_qa_10k").select("qa_id", text.normalize_text(F.col("question")).alias("question"), text.normalize_text(F.col("answer")).alias("answer"))


@query(f"SELECT doc_id, array_to_string({_tokens('text')}, '|') AS tokens FROM documents WHERE text IS NOT NULL")
def finance_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(text.finance_tokens(F.col("text")), "|").alias("tokens"))


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(s, '{w}')" for w in (x.replace("'", "''") for x in words)) + ")"


@query(f"""WITH r AS (SELECT DISTINCT section, lower({_strip("coalesce(section, '')")}) AS s FROM (SELECT section FROM chunks UNION ALL SELECT source_section FROM benchmark_questions)),
  f AS (SELECT section, list_filter([CASE WHEN {_has("1a", "risk")} THEN 'item_1a' END, CASE WHEN {_has("item 1 ", "business overview", "human capital", "employee")} AND NOT contains(s, '1a') THEN 'item_1' END,
    CASE WHEN {_has(*text.SECTION_RULES[0][1])} THEN 'item_7' END, CASE WHEN {_has(*text.SECTION_RULES[1][1])} THEN 'item_8' END, CASE WHEN {_has("operations", "income", "revenue")} THEN 'x' END], lambda x: x IS NOT NULL) AS l FROM r)
  SELECT section, CASE WHEN len(l) = 0 THEN 'item_7' ELSE array_to_string(list_concat(list_filter(l, lambda x: x <> 'x'), CASE WHEN NOT list_contains(l, 'x') THEN [] ELSE list_filter(['item_7', 'item_8'], lambda x: NOT list_contains(l, x)) END), ',') END AS items FROM f""")
def canonical_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("section").unionAll(table(spark, d, "benchmark_questions").select("source_section")).distinct()
    return rows.select("section", F.array_join(text.canonical_sections(F.col("section")), ",").alias("items"))


@query("SELECT qa_id, TRY_CAST(nullif(regexp_extract(filing, '((?:19|20)\\d{2})', 1), '') AS INT) AS year FROM financial_qa_10k")
def filing_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_qa_10k").select("qa_id", text.filing_year(F.col("filing")).alias("year"))


# --- filings and tables

@query("""SELECT ticker, TRY_CAST(coalesce(nullif(regexp_extract(report_date, '^(\\d{4})', 1), ''), nullif(regexp_extract(filing_date, '^(\\d{4})', 1), '')) AS INT) AS year, filing_date, report_date, accession_number, source_file
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, coalesce(nullif(regexp_extract(report_date, '^(\\d{4})', 1), ''), nullif(regexp_extract(filing_date, '^(\\d{4})', 1), '')) ORDER BY ingested_at, accession_number) AS n FROM filings WHERE form = '10-K' AND coalesce(nullif(regexp_extract(report_date, '^(\\d{4})', 1), ''), nullif(regexp_extract(filing_date, '^(\\d{4})', 1), '')) IS NOT NULL) WHERE n = 1""")
def filing_first_per_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filings").withColumn("primary_doc", F.col("source_file")).withColumn("pos", F.struct("ingested_at", "accession_number"))
    first = filings.annual_filings(rows, by="ticker", cik=F.col("accession_number").substr(1, 10))
    return first.select("ticker", "year", "filing_date", "report_date", "accession_number", F.col("primary_doc").alias("source_file"))


@query("""SELECT upper(c.ticker) AS ticker, lpad(c.cik, 10, '0') AS cik FROM (SELECT DISTINCT ticker, cik FROM companies) c""")
def ticker_ciks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "companies")
    return filings.resolve_ciks(c.select("ticker"), c.select("ticker", "cik"))


@query(f"""WITH {_CORPUS} SELECT chunk_id, ticker, fiscal_year, section, token_count_est::INT AS token_count_est FROM corpus""")
def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("chunk_id", "ticker", "fiscal_year", "section", "token_count_est")


@query("""WITH e AS (SELECT chunk_id, max(coalesce(length(text), -1)) AS n FROM chunks WHERE ingested_at < TIMESTAMP '2024-07-01' GROUP BY ALL), i AS (SELECT chunk_id, max(coalesce(length(text), -1)) AS n FROM chunks WHERE ingested_at >= TIMESTAMP '2024-07-01' GROUP BY ALL)
  SELECT * FROM i UNION ALL SELECT * FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM i WHERE chunk_id IS NOT NULL)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n"), "ingested_at")
    part = [c.where(w).groupBy("chunk_id").agg(F.max("n").alias("n")) for w in ("ingested_at < timestamp'2024-07-01'", "ingested_at >= timestamp'2024-07-01'")]
    return sinks.merged(part[0], part[1], "chunk_id")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", html.html_text(F.col("text")).alias("text"))


@query()
def extract_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).groupBy("ticker", "fiscal_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("html"))
    return html.parse_filings(rows.withColumn("source_file", F.concat_ws("_", "ticker", F.col("fiscal_year").cast("string"))))


# --- search

@query(f"WITH {_CORPUS}, {_QUESTIONS}, {_ALL}, {_BM25} SELECT qid, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index = bm25.build(corpus(spark, d), "chunk_id", "text")
    return bm25.search(index, questions(spark, d), 20).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_CORPUS}, {_QUESTIONS}, {_FILTER}, {_BM25} SELECT qid, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    allowed = search.narrowed(c, section="ITEM_7 ", fiscal_year=2023).select(F.col("chunk_id").alias("id"))
    return bm25.search(bm25.build(c, "chunk_id", "text"), questions(spark, d), 20, allowed).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_CORPUS}, {_QUESTIONS}, {_ALL}, {_BM25} SELECT n, round(avgdl, 6) AS avgdl, round((SELECT avg(raw) FROM raws), 6) AS mean_idf FROM whole")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(corpus(spark, d), "chunk_id", "text").stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {_VECTORS} SELECT qid, id, round(score, 5) AS score, rank FROM dranked WHERE rank <= 5")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = usable_vectors(spark, d)
    return dense.search(v, v.where("vector_id % 50 = 0"), 5, "vector_id", "vector", "vector_id").select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_VECTORS} SELECT qid, id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM dense WHERE id IN (SELECT vector_id FROM chunk_vectors WHERE model = 'enc_small_v1') QUALIFY rank <= 5""")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = usable_vectors(spark, d)
    return dense.search(v.where("model = 'enc_small_v1'"), v.where("vector_id % 50 = 0"), 5, "vector_id", "vector", "vector_id").select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_CORPUS}, {_VECTORS}, cv2 AS (SELECT chunk_id AS id, arg_min(v, id) AS v, arg_min(n, id) AS n FROM (SELECT vs.*, c.chunk_id FROM vs JOIN chunk_vectors c ON c.vector_id = vs.id WHERE c.chunk_id IS NOT NULL) GROUP BY ALL),
  qv2 AS (SELECT vs.id AS qid, vs.v, vs.n FROM vs JOIN chunk_vectors c ON c.vector_id = vs.id JOIN corpus USING (chunk_id) WHERE vs.id % 50 = 0 AND {_strip("text")} <> '')
  SELECT qid, cv2.id, round(list_inner_product(cv2.v, qv2.v) / (cv2.n * qv2.n), 5) AS score, ticker, fiscal_year, section, row_number() OVER (PARTITION BY qid ORDER BY round(list_inner_product(cv2.v, qv2.v) / (cv2.n * qv2.n), 9) DESC, cv2.id) AS rank FROM cv2 JOIN corpus ON cv2.id = corpus.chunk_id, qv2 WHERE section = 'item_7' AND fiscal_year = 2023 QUALIFY rank <= 5""")
def dense_retrieve_filtered(spark: SparkSession, d: str) -> DataFrame:
    hits = search.retrieve(corpus(spark, d), text_queries(spark, d), chunk_vectors(spark, d), section=" Item_7", fiscal_year=2023)
    return hits.select("qid", "id", F.round("score", 5).alias("score"), "ticker", "fiscal_year", "section", "rank")


@query(f"""WITH {_CORPUS}, v AS (SELECT chunk_id, arg_min(v, vector_id) AS v FROM (SELECT vector_id, chunk_id, vector::DOUBLE[] AS v FROM chunk_vectors) WHERE {_USABLE} AND chunk_id IS NOT NULL GROUP BY chunk_id) SELECT chunk_id, ticker, section, len(v)::INT AS dims FROM v JOIN corpus USING (chunk_id)""")
def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    v, c = chunk_vectors(spark, d), corpus(spark, d)
    both = dense.attach(v.join(c.select("chunk_id"), "chunk_id", "left_semi"), c.join(v.select("chunk_id"), "chunk_id", "left_semi"))
    return both.select("chunk_id", "ticker", "section", F.size("vector").alias("dims"))


@query(f"""WITH v AS (SELECT vector_id, v FROM (SELECT vector_id, vector::DOUBLE[] AS v FROM chunk_vectors) WHERE {_USABLE}), m AS (SELECT *, list_avg(v) AS a, sqrt(list_avg(list_transform(v, lambda x: (x - list_avg(v)) ** 2)) + 1e-12) AS s, list_max(v) AS t FROM v)
  SELECT vector_id, round(list_max(list_transform(v, lambda x: (x - a) / s * 2 + 1)), 4) AS normed, round(list_sum(list_transform(v, lambda x: 0.5 * x * (1 + (2 / (1 + exp(-2 * sqrt(2 / pi()) * (x + 0.044715 * x ** 3))) - 1)))), 4) AS activated, round(1 / list_sum(list_transform(v, lambda x: exp(x - t))), 4) AS attended FROM m""")
def tensor_kernels(spark: SparkSession, d: str) -> DataFrame:
    """Layer norm (scale 2, shift 1), activation and softmax of the encoder, over all usable vectors."""

    def run(batches):
        for b in batches:
            x = np.stack(b["vector"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, 64))
            yield pd.DataFrame({"vector_id": b["vector_id"], "normed": transformer.layer_norm(x, np.float64(2), np.float64(1)).max(1).round(4), "activated": transformer.gelu(x).sum(1).round(4), "attended": transformer.softmax(x).max(1).round(4)})

    return usable_vectors(spark, d).select("vector_id", "vector").mapInPandas(run, "vector_id bigint, normed double, activated double, attended double")


@query(f"""WITH v AS (SELECT chunk_id, sqrt(list_inner_product(v, v)) AS n FROM (SELECT chunk_id, vector::DOUBLE[] AS v FROM chunk_vectors) WHERE {_USABLE} AND chunk_id IS NOT NULL), c AS (SELECT DISTINCT chunk_id FROM chunks)
  SELECT count(*) AS vectors, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS avg_norm, bool_and(abs(n - 1) <= 1e-4) AS unit, (SELECT count(*) FROM c) AS chunks, (SELECT count(DISTINCT chunk_id) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c)) AS without_chunk, (SELECT count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v)) AS without_vector FROM v""")
def vector_check(spark: SparkSession, d: str) -> DataFrame:
    return dense.verify(usable_vectors(spark, d).where("chunk_id is not null"), table(spark, d, "chunks").select("chunk_id").distinct())


_TEXT_QUERIES = f"""tv AS (SELECT vector_id, chunk_id, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vector_id, chunk_id, vector::DOUBLE[] AS v FROM chunk_vectors) WHERE {_USABLE} AND chunk_id IS NOT NULL),
  cv AS (SELECT chunk_id AS id, arg_min(v, vector_id) AS v, arg_min(n, vector_id) AS n FROM tv GROUP BY ALL),
  qv AS (SELECT vector_id AS qid, text AS query, v, n FROM tv JOIN corpus USING (chunk_id) WHERE vector_id % 50 = 0), qs AS (SELECT qid, query FROM qv WHERE {_strip("query")} <> ''),
  dd AS (SELECT qid, cv.id, list_inner_product(cv.v, qv.v) / (cv.n * qv.n) AS score FROM cv, qv WHERE qid IN (SELECT qid FROM qs)),
  dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM dd)"""
_HYBRID = """fused AS (SELECT qid, id, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS rrf, d.rank AS dense_rank, s.rank AS sparse_rank FROM (SELECT * FROM dr WHERE rank <= 25) d FULL JOIN (SELECT * FROM ranked WHERE rank <= 25) s USING (qid, id)),
  fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) AS rank FROM fused)"""


@query(f"WITH {_CORPUS}, {_TEXT_QUERIES}, {_ALL}, {_BM25}, {_HYBRID} SELECT qid, fr.id, round(rrf, 9) AS score, dense_rank, sparse_rank, rank FROM fr JOIN corpus ON chunk_id = fr.id WHERE rank <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = written(corpus(spark, d))
    hits = search.retrieve(rows, text_queries(spark, d, rows), chunk_vectors(spark, d), mode="hybrid")
    return hits.select("qid", "id", F.round("rrf_score", 9).alias("score"), "dense_rank", "sparse_rank", "rank")


@query(f"""WITH {_CORPUS}, {_TEXT_QUERIES}, {_ALL}, {_BM25}, {_HYBRID},
  scored2 AS (SELECT qid, fr.id, fr.rank AS old, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM fr JOIN corpus ON chunk_id = fr.id JOIN qs USING (qid) WHERE fr.rank <= 25),
  rr AS (SELECT qid, id, old, coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0.0) AS rerank FROM scored2)
  SELECT qid, id, round(rerank, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(rerank, 9) DESC, old) AS rank FROM rr QUALIFY rank <= 5""")
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = written(corpus(spark, d))
    hits = search.retrieve(rows, text_queries(spark, d, rows), chunk_vectors(spark, d), mode="hybrid", reranked=True)
    return hits.select("qid", "id", F.round("rerank_score", 6).alias("score"), "rank")


def _bm25_hits(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return written(search.retrieve(corpus(spark, d), questions(spark, d), k=k, mode="bm25").withColumn("score", F.round("score", 9)))


_HITS = f"WITH {_CORPUS}, {_QUESTIONS}, {_ALL}, {_BM25}, hits AS (SELECT qid, r.id, round(score, 9) AS score, rank, ticker, fiscal_year, section, text, token_count_est AS token_count FROM ranked r JOIN corpus ON chunk_id = r.id WHERE rank <= 5)"


@query(f"""{_HITS}, p AS (SELECT * REPLACE (round(score, 4) AS score), sum(token_count) OVER (PARTITION BY qid ORDER BY rank) AS s, count(*) OVER (PARTITION BY qid) AS passages FROM hits)
  SELECT qid, '=== RETRIEVED 10-K CONTEXT (' || any_value(passages) || ' passages) ===' || chr(10) || chr(10) || string_agg('[SOURCE ' || rank || ' | ' || coalesce(ticker, 'null') || ' FY' || coalesce(fiscal_year::VARCHAR, 'null') || ' ' || section || ' | Score: ' || printf('%.4f', score) || ']' || chr(10) || {_strip("text")} || chr(10), chr(10) ORDER BY rank) || repeat('=', 57) AS context, count(*) AS used, any_value(passages) AS passages FROM p WHERE s <= 900 OR rank = 1 GROUP BY qid""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return fusion.pack_context(_bm25_hits(spark, d).withColumn("score", F.round("score", 4)), 900)


_EXTRACTED = f"""q AS (SELECT qid, query, CASE WHEN contains(query, '2024') THEN 2024 WHEN contains(query, '2023') THEN 2023 WHEN contains(query, '2022') THEN 2022 END AS year, list_filter(regexp_extract_all(lower(query), '\\b\\w{{3,}}\\b'), lambda w: w NOT IN {text.QUERY_STOPWORDS}) AS words FROM qs),
  r AS (SELECT q.*, rank, fiscal_year, score, text FROM q JOIN hits USING (qid)),
  c AS (SELECT * EXCLUDE (s), {_strip("s")} AS s FROM (SELECT *, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM (SELECT *, string_split(regexp_replace(text, '([.!?\n])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM r WHERE year IS NULL OR fiscal_year = year))),
  m AS (SELECT *, len(list_filter(words, lambda w: contains(lower(s), w))) AS m FROM c WHERE length(s) > 20),
  b AS (SELECT qid, rank, {_strip(f"regexp_replace(s, '{_WS}+', ' ', 'g')")} AS s FROM m WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(m * 2.0 + CASE WHEN score <> 0 THEN score ELSE 0.5 END, 9) DESC, rank, pos) = 1),
  t AS (SELECT qid, {_strip(f"regexp_replace(CASE WHEN contains(b, chr(10)) THEN string_split(b, chr(10))[1] ELSE left(b, 200) END, '{_WS}+', ' ', 'g')")} AS h FROM (SELECT qid, {_strip("text")} AS b FROM r WHERE rank = 1 AND score > 0)),
  a AS (SELECT q.qid, coalesce((SELECT regexp_replace(s, '[,;]+$', '') || CASE WHEN regexp_replace(s, '[,;]+$', '') LIKE '%.' THEN '' ELSE '.' END || ' [SOURCE ' || rank || ']' FROM b WHERE b.qid = q.qid), (SELECT CASE WHEN length(h) > 30 THEN h || CASE WHEN h LIKE '%.' THEN '' ELSE '.' END || ' [SOURCE 1]' END FROM t WHERE t.qid = q.qid), '{prompts.REFUSAL}') AS answer FROM q)"""


@query(f"""{_HITS}, {_EXTRACTED}
  SELECT qid, answer, array_to_string(regexp_extract_all(answer, '\\[SOURCE\\s+\\d+\\]'), ',') AS citations, regexp_matches(answer, '\\[SOURCE\\s+\\d+\\]') AS has_citation, answer = '{prompts.REFUSAL}' AS is_refusal, (SELECT count(*) FROM hits WHERE hits.qid = a.qid)::INT AS passages FROM a""")
def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25_hits(spark, d)
    rows = answer.answer_records(answer.extract_answers(questions(spark, d), hits), hits)
    return rows.select("qid", "answer", F.array_join("citations", ",").alias("citations"), "has_citation", "is_refusal", F.size("sources").alias("passages"))


@query("""WITH long AS (SELECT i AS qid, 'What ' || i AS query FROM range(4) t(i)) SELECT qid, CASE qid WHEN 0 THEN 'A line of the passage that is longer than thirty. [SOURCE 1]' WHEN 1 THEN rtrim(repeat('ab cd ', 40)[:200]) || '. [SOURCE 1]' ELSE '""" + prompts.REFUSAL + """' END AS answer FROM long""")
def answer_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Passages without a word of the question: first line, first 200 characters, too short, and a score of 0."""
    texts = [("A line of  the passage that is longer than thirty\nand more", 1.0), ("ab cd " * 40, 0.5), ("short", 1.0), ("x" * 100, 0.0)]
    hits = spark.createDataFrame([(q, 1, None, s, t) for q, (t, s) in enumerate(texts)], "qid bigint, rank int, fiscal_year int, score double, text string")
    return answer.extract_answers(spark.range(4).select(F.col("id").alias("qid"), F.concat(F.lit("What "), F.col("id").cast("string")).alias("query")), hits)


_HEADER = f"'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{prompts.SYSTEM.replace(chr(39), chr(39) * 2)}' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)"


@query(f"""{_HITS}, p AS (SELECT * REPLACE (round(score, 4) AS score), sum(token_count) OVER (PARTITION BY qid ORDER BY rank) AS s, count(*) OVER (PARTITION BY qid) AS passages FROM hits),
  c AS (SELECT qid, '=== RETRIEVED 10-K CONTEXT (' || any_value(passages) || ' passages) ===' || chr(10) || chr(10) || string_agg('[SOURCE ' || rank || ' | ' || coalesce(ticker, 'null') || ' FY' || coalesce(fiscal_year::VARCHAR, 'null') || ' ' || section || ' | Score: ' || printf('%.4f', score) || ']' || chr(10) || {_strip("text")} || chr(10), chr(10) ORDER BY rank) || repeat('=', 57) AS context FROM p WHERE s <= 2000 OR rank = 1 GROUP BY qid)
  SELECT qid, {_HEADER} || coalesce(context, '{prompts.EMPTY_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || {_strip("query")} || chr(10) || 'Answer:' || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM qs LEFT JOIN c USING (qid)""")
def rag_prompts(spark: SparkSession, d: str) -> DataFrame:
    packed = fusion.contexts(questions(spark, d), _bm25_hits(spark, d).withColumn("score", F.round("score", 4)))
    return questions(spark, d).join(packed, "qid").select("qid", prompts.prompt(F.col("query"), F.col("context")).alias("prompt"))


@query()
def embedded_search(spark: SparkSession, d: str) -> DataFrame:
    encoder = embed.ModelEmbedder(embed.hashing())
    return dense.search(embed.embed(corpus(spark, d), encoder), embed.embed_queries(questions(spark, d), encoder), 5, "chunk_id").select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_CORPUS}, {_QUESTIONS}, {_ALL}, {_BM25},
  wide AS (SELECT qid, r.id, rank AS old, ticker, fiscal_year, section, text, token_count_est AS token_count, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM ranked r JOIN corpus ON chunk_id = r.id JOIN qs USING (qid) WHERE rank <= 25),
  hits AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, old) AS rank, ticker, fiscal_year, section, text, token_count FROM (SELECT *, coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0.0) AS score FROM wide) QUALIFY rank <= 5),
  {_EXTRACTED},
  p AS (SELECT *, sum(token_count) OVER (PARTITION BY qid ORDER BY rank) AS s, count(*) OVER (PARTITION BY qid) AS passages FROM hits),
  x AS (SELECT qid, '=== RETRIEVED 10-K CONTEXT (' || any_value(passages) || ' passages) ===' || chr(10) || chr(10) || string_agg('[SOURCE ' || rank || ' | ' || coalesce(ticker, 'null') || ' FY' || coalesce(fiscal_year::VARCHAR, 'null') || ' ' || section || ' | Score: ' || printf('%.4f', score) || ']' || chr(10) || {_strip("text")} || chr(10), chr(10) ORDER BY rank) || repeat('=', 57) AS context FROM p WHERE s <= 1800 OR rank = 1 GROUP BY qid)
  SELECT qid, answer, (length({_HEADER} || coalesce(context, '{prompts.EMPTY_CONTEXT}') || chr(10) || chr(10) || 'Question: ' || {_strip("query")} || chr(10) || 'Answer:' || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) // 4)::INT AS prompt_tokens_est, (SELECT count(*) FROM hits WHERE hits.qid = a.qid)::INT AS passages FROM a JOIN qs USING (qid) LEFT JOIN x USING (qid)""")
def service_answers(spark: SparkSession, d: str) -> DataFrame:
    return service.respond(corpus(spark, d), questions(spark, d)).select("qid", "answer", "prompt_tokens_est", F.size("sources").alias("passages"))


@query(f"WITH {_CORPUS} SELECT chunk_id, 256 AS dims, coalesce(fiscal_year = 2023, false) AS known FROM corpus")
def embedding_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks, those of 2023 taken over from an earlier run, the rest encoded anew."""
    encoder, rows = embed.ModelEmbedder(embed.hashing()), corpus(spark, d)
    known = embed.embed(rows.where("fiscal_year = 2023"), encoder)
    out = embed.refresh(rows, known, encoder).select("chunk_id", F.size("vector").alias("dims"))
    return out.join(rows.select("chunk_id", F.coalesce(F.col("fiscal_year") == 2023, F.lit(False)).alias("known")), "chunk_id")


@query("SELECT item_id AS qid, 'Without the filings no sourced answer to \"' || question || '\" can be given.' AS answer FROM benchmark_questions")
def unsourced_answers(spark: SparkSession, d: str) -> DataFrame:
    return service.answer_without_passages(questions(spark, d))


# --- evaluation

_JUDGED = f"""{_HITS}, items AS (SELECT item_id AS qid, source_company, answer_type, CASE source_section WHEN 'Item 1A' THEN ['item_1a'] WHEN 'Item 7' THEN ['item_7'] WHEN 'Item 8' THEN ['item_8'] ELSE ['item_7'] END AS secs FROM benchmark_questions),
  judged AS (SELECT i.qid, any_value(source_company) AS expected_ticker, any_value(answer_type) AS answer_type, min(CASE WHEN h.ticker = source_company AND list_contains(secs, h.section) THEN rank END) AS match_rank FROM items i LEFT JOIN hits h USING (qid) GROUP BY i.qid)"""


def _hr(n: int) -> str:
    return f"round(avg(CASE WHEN match_rank <= {n} THEN 1.0 ELSE 0.0 END) * 100, 6)"


_MRR = "round(avg(coalesce(1.0 / match_rank, 0)), 6)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge(evaluate.convert_benchmark(table(spark, d, "benchmark_questions")), _bm25_hits(spark, d))


@query(f"{_JUDGED} SELECT {_hr(1)} AS hit_rate_at_1, {_hr(3)} AS hit_rate_at_3, {_hr(5)} AS hit_rate_at_5, {_MRR} AS mrr, count(*) AS total_queries FROM judged")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(_judged(spark, d))


@query(f"{_JUDGED} SELECT 'answer_type' AS slice, answer_type AS value, count(*) AS count, {_hr(1)} AS hr1, {_hr(5)} AS hr5, {_MRR} AS mrr FROM judged GROUP BY answer_type UNION ALL SELECT 'expected_ticker', expected_ticker, count(*), {_hr(1)}, {_hr(5)}, {_MRR} FROM judged GROUP BY expected_ticker")
def ir_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.breakdowns(_judged(spark, d), ["answer_type", "expected_ticker"])


@query(f"{_JUDGED}, m AS (SELECT {_hr(1)} AS a, {_hr(3)} AS b, {_hr(5)} AS c, {_MRR} AS d FROM judged), t AS (SELECT answer_type AS value, {_hr(5)} AS hr5, {_MRR} AS mrr FROM judged GROUP BY answer_type) SELECT 'bm25' AS run, * FROM (SELECT 'hit_rate_at_1' AS key, a AS value FROM m UNION ALL SELECT 'hit_rate_at_3', b FROM m UNION ALL SELECT 'hit_rate_at_5', c FROM m UNION ALL SELECT 'mrr', d FROM m UNION ALL SELECT 'type_' || lower(translate(value, ' /', '__')) || '_hr5', hr5 FROM t UNION ALL SELECT 'type_' || lower(translate(value, ' /', '__')) || '_mrr', mrr FROM t)")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    by = evaluate.breakdowns(j, ["answer_type"])
    return evaluate.metric_rows("bm25", evaluate.metrics(j), by)


@query(f"{_JUDGED}, w AS (SELECT row_number() OVER (ORDER BY qid) AS n, round(avg(CASE WHEN match_rank <= 1 THEN 100.0 ELSE 0.0 END) OVER (ORDER BY qid), 6) AS hr1, round(avg(coalesce(1.0 / match_rank, 0)) OVER (ORDER BY qid), 6) AS mrr, count(*) OVER () AS a FROM judged) SELECT n, hr1, mrr FROM w WHERE n % 20 = 0 OR n = a")
def ir_progress(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.progress(_judged(spark, d))


def _run(name: str, hits: str) -> str:
    judged = f"(SELECT i.qid, min(CASE WHEN h.ticker = source_company AND list_contains(secs, h.section) THEN rank END) AS match_rank FROM items i LEFT JOIN {hits} h USING (qid) GROUP BY i.qid)"
    return " UNION ALL ".join(f"SELECT '{name}' AS run, '{k}' AS key, {e} AS value FROM {judged}" for k, e in (("hit_rate_at_1", _hr(1)), ("hit_rate_at_3", _hr(3)), ("hit_rate_at_5", _hr(5)), ("mrr", _MRR)))


@query(f"""{_JUDGED}, nh AS (SELECT * REPLACE (CASE WHEN contains(lower(text), 'item 8') THEN 'item_8' WHEN contains(lower(text), 'item 7') THEN 'item_7' WHEN contains(lower(text), 'item 1a') THEN 'item_1a' WHEN contains(lower(text), 'item 1') THEN 'item_1' ELSE 'unknown' END AS section) FROM hits),
  wide AS (SELECT qid, rank AS old, ticker, section, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM ranked r JOIN corpus ON chunk_id = r.id JOIN qs USING (qid) WHERE rank <= 25),
  rh AS (SELECT qid, ticker, section, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0.0), 9) DESC, old) AS rank FROM wide QUALIFY rank <= 5),
  runs AS ({_run("bm25", "hits")} UNION ALL {_run("naive", "nh")} UNION ALL {_run("bm25_rerank", "rh")})
  SELECT r.*, b.value AS base_value, round(r.value - b.value, 6) AS delta FROM runs r JOIN runs b ON b.run = 'naive' AND b.key = r.key""")
def pipeline_delta(spark: SparkSession, d: str) -> DataFrame:
    benchmark = evaluate.convert_benchmark(table(spark, d, "benchmark_questions"))
    rows = written(corpus(spark, d))
    asked = questions(spark, d)
    found = written(bm25.search(bm25.build(rows, "chunk_id", "text"), asked.where(~text.blank(F.col("query"))), 25))  # the runs differ only in what they do with it
    rows = written(search.picked(rows, found.select("id")))
    flat = rows.withColumn("section", text.guess_section(F.col("text")))
    runs = {name: search.retrieve(c, asked, lexical=found, mode="bm25", reranked=name == "bm25_rerank") for name, c in (("bm25", rows), ("naive", flat), ("bm25_rerank", rows))}
    parts = [evaluate.metric_rows(name, evaluate.metrics(evaluate.judge(benchmark, h))) for name, h in runs.items()]
    return evaluate.deltas(written(parts[0].unionByName(parts[1]).unionByName(parts[2])), "naive")


_DELTAS = SQL["pipeline_delta"]


@query(f"SELECT key, any_value(value) FILTER (run = 'naive') AS naive, any_value(value) FILTER (run = 'bm25') AS bm25, any_value(value) FILTER (run = 'bm25_rerank') AS bm25_rerank, round(any_value(value) FILTER (run = 'bm25_rerank') - any_value(value) FILTER (run = 'naive'), 6) AS gain FROM ({_DELTAS}) GROUP BY key")
def pipeline_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.comparison(pipeline_delta(spark, d), ["naive", "bm25", "bm25_rerank"])


@query(f"SELECT rpad(key, 28, ' ') || lpad(printf('%.4f', n), 14, ' ') || lpad(printf('%.4f', r), 14, ' ') || lpad(printf('%.4f', round(r - n, 6)), 14, ' ') AS line FROM (SELECT key, any_value(value) FILTER (run = 'naive') AS n, any_value(value) FILTER (run = 'bm25_rerank') AS r FROM ({_DELTAS}) GROUP BY key)")
def pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.printed(evaluate.comparison(pipeline_delta(spark, d), ["naive", "bm25_rerank"]))


@query()
def ir_report(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return evaluate.report("bm25", evaluate.metrics(j), evaluate.breakdowns(j, ["answer_type", "expected_ticker"]), j)


# --- held-out texts and training records

_LEAKS = f"""e AS (SELECT qa_id, {_norm("question")} AS nq, {_norm("answer")} AS na, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')) AS ts FROM financial_qa_10k),
  b AS (SELECT {_norm("question")} AS nq, {_norm("gold_answer")} AS na, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS ts FROM benchmark_questions),
  near AS (SELECT DISTINCT qa_id FROM e, b WHERE len(e.ts) > 0 AND len(b.ts) > 0 AND len(list_intersect(e.ts, b.ts)) / (len(e.ts) + len(b.ts) - len(list_intersect(e.ts, b.ts))) >= 0.8 - 1e-12),
  f AS (SELECT qa_id, nq, nq <> '' AND nq IN (SELECT nq FROM b) AS exact, qa_id IN (SELECT qa_id FROM near) AS near, length(na) >= 20 AND na IN (SELECT na FROM b WHERE length(na) >= 20) AS by_answer FROM e)"""


@query(f"WITH {_LEAKS} SELECT qa_id, exact, near, by_answer, nq <> '' AND (exact OR near OR by_answer) AS leak FROM f")
def leak_flags(spark: SparkSession, d: str) -> DataFrame:
    return heldout.leak_flags(table(spark, d, "financial_qa_10k"), table(spark, d, "benchmark_questions"))


_KEPT = "kept AS (SELECT * FROM records WHERE qa_id NOT IN (SELECT qa_id FROM f WHERE nq <> '' AND (exact OR near OR by_answer)))"


@query(f"WITH {_LEAKS}, {_RECORDS}, {_KEPT} SELECT qa_id, question, answer, context, ticker, fiscal_year, '10-K' AS section, 'primary' AS source FROM kept")
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    return heldout.without_leaks(records(spark, d), leak_flags(spark, d))


@query(f"WITH {_RECORDS} SELECT qa_id, question, answer, context, ticker, fiscal_year, '10-K' AS section, 'primary' AS source FROM records")
def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d)


@query(f"WITH {_RECORDS} SELECT qa_id, CASE WHEN regexp_matches(answer, '\\[SOURCE\\s+\\d+\\]') THEN answer ELSE answer || ' [SOURCE 1]' END AS target, array_to_string(regexp_extract_all(answer, '\\[SOURCE\\s+\\d+\\]'), ',') AS tags FROM records")
def training_targets(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("qa_id", prompts.training_target(F.col("answer")).alias("target"), F.array_join(text.citations(F.col("answer")), ",").alias("tags"))


_CHAT = "'=== RETRIEVED 10-K CONTEXT (1 passage) ===' || chr(10) || chr(10) || '[SOURCE 1 | ' || coalesce(ticker, 'null') || ' FY' || coalesce(fiscal_year::VARCHAR, 'null') || ' 10-K | Score: 1.0000]' || chr(10) || context || chr(10) || repeat('=', 57) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'"


@query(f"""WITH {_RECORDS} SELECT qa_id, 'ft_' || CASE WHEN n < 1000000 THEN lpad(n::VARCHAR, 6, '0') ELSE n::VARCHAR END AS id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{prompts.SYSTEM.replace("'", "''")}' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || {_CHAT} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || CASE WHEN regexp_matches(answer, '\\[SOURCE\\s+\\d+\\]') THEN answer ELSE answer || ' [SOURCE 1]' END || '<|eot_id|>' AS text
  FROM (SELECT *, row_number() OVER (ORDER BY qa_id) - 1 AS n FROM records)""")
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    return dataset.build_examples(records(spark, d), ["qa_id"]).select("qa_id", "id", "text")


@query(f"""WITH {_RECORDS}, o AS (SELECT qa_id, row_number() OVER (ORDER BY md5('42:' || qa_id), qa_id) AS n, count(*) OVER () AS a FROM records) SELECT qa_id, CASE WHEN n <= greatest(1, round_even(a * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM o""")
def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(records(spark, d), 0.2, 42, "qa_id").select("qa_id", "split")


@query(f"""WITH {_LEAKS}, {_RECORDS}, {_KEPT}, n AS (SELECT (SELECT count(*) FROM financial_qa_10k) AS raw, (SELECT count(*) FROM records) AS after_filter, (SELECT count(*) FROM kept) AS kept)
  SELECT '2025-01-01T00:00:00Z' AS generated_at, 'primary' AS source, raw, after_filter, after_filter - kept AS leaks_removed, kept, kept - greatest(1, round_even(kept * 0.1, 0))::BIGINT AS train, greatest(1, round_even(kept * 0.1, 0))::BIGINT AS val, '42' AS seed, '0.1' AS val_fraction FROM n""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    flags = leak_flags(spark, d).join(rows.select("qa_id"), "qa_id", "left_semi")
    parted = dataset.split(heldout.without_leaks(rows, flags), 0.1, 42, "qa_id")
    out = dataset.manifest("primary", table(spark, d, "financial_qa_10k"), rows, flags, parted, {"seed": "42", "val_fraction": "0.1"}, "2025-01-01T00:00:00Z")
    return out.select("generated_at", "source", "counts.*", F.col("config")["seed"].alias("seed"), F.col("config")["val_fraction"].alias("val_fraction"))


_FACT = text.NUMERIC_FACT.replace("'", "''")


@query(f"""WITH {_CORPUS}, c AS (SELECT * EXCLUDE (parts), unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM corpus)),
  f AS (SELECT *, 'What does ' || coalesce(ticker, '') || ' report regarding ' || regexp_replace(regexp_replace(regexp_extract(s, '{_FACT}', 1), '\\s+', ' ', 'g'), '^[ ,-]+|[ ,-]+$', '', 'g') || ' in its FY' || coalesce(fiscal_year::VARCHAR, '') || ' 10-K?' AS question FROM c WHERE regexp_extract(s, '{_FACT}', 1) <> '' AND regexp_extract(s, '{_FACT}', 2) <> '')
  SELECT question, {_strip("s")} AS answer, text AS context, ticker, fiscal_year, section, chunk_id, pos::INT AS pos FROM f QUALIFY row_number() OVER (PARTITION BY {_norm("question")} ORDER BY chunk_id, pos) = 1""")
def synthetic_qa(spark: SparkSession, d: str) -> DataFrame:
    return dataset.synthesize(corpus(spark, d))


@query(f"SELECT * FROM ({SQL['synthetic_qa']}) ORDER BY chunk_id, pos LIMIT 50")
def synthetic_first(spark: SparkSession, d: str) -> DataFrame:
    """The cap of the operator: the first 50 pairs by chunk and place."""
    return dataset.synthesize(corpus(spark, d), most=50)


@query(f"""WITH {_RECORDS} SELECT 'primary' AS choice, count(*) AS n FROM records UNION ALL SELECT 'fallback', count(*) FROM ({SQL['synthetic_qa']})""")
def chosen_records(spark: SparkSession, d: str) -> DataFrame:
    """The primary records where there are any, else the synthetic ones."""
    primary, synthetic = records(spark, d), dataset.synthesize(corpus(spark, d))
    parts = [dataset.chosen(p, synthetic).agg(F.count("*").alias("n")).select(F.lit(name).alias("choice"), "n") for name, p in (("primary", primary), ("fallback", primary.where("fiscal_year > 3000")))]
    return parts[0].unionByName(parts[1])


@query(f"SELECT count(*) AS rows, count(*) FILTER ({_strip('coalesce(text, chr(32))')} = '') AS blank_rows, min(CASE WHEN {_strip('coalesce(text, chr(32))')} = '' THEN id END) AS first_blank, coalesce(max(length(text)), 0)::INT AS longest, count(*) FILTER ({_strip('coalesce(text, chr(32))')} = '') || ' blank texts, the first at ' || min(CASE WHEN {_strip('coalesce(text, chr(32))')} = '' THEN id END) AS error FROM train")
def training_validation(spark: SparkSession, d: str) -> DataFrame:
    return dataset.validate(table(spark, d, "train"))


# --- quantities

@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return extract_measures(table(spark, d, "chunks"), table(spark, d, "measures"), table(spark, d, "units"))


_UNITS = {"mass": {"kg": 1.0, "lb": 0.45359237, "tonne": 1000.0}, "density": {"kg/m3": 1.0, "lb/ft3": 16.018463373960142, "t/m3": 1000.0}, "volume": {"m3": 1.0, "ft3": 0.028316846592, "l": 0.001}}
_COMBOS = ", ".join(f"({9 * i + 3 * j + k}, '{a}', '{b}', '{c}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (a, x) in enumerate(_UNITS["mass"].items()) for j, (b, y) in enumerate(_UNITS["density"].items()) for k, (c, z) in enumerate(_UNITS["volume"].items()))
_MEASURED = "l_orderkey, l_linenumber, l_suppkey, l_quantity * 2.5 / CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.45359237 ELSE 1000 END AS mass, 2500 / CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 16.018463373960142 ELSE 1000 END AS density, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 1000 / CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.028316846592 ELSE 0.001 END END AS volume"


@query(f"""WITH t AS (SELECT *, row_number() OVER () AS n FROM (SELECT {_MEASURED} FROM lineitem)), c(i, mass_unit, density_unit, volume_unit, x, y, z) AS (VALUES {_COMBOS}),
  r AS (SELECT t.*, c.*, CASE WHEN mass > 0 AND density > 0 AND volume > 0 THEN round(abs(ln(mass * x) - ln(density * y) - ln(volume * z)), 9) END AS r FROM t, c)
  SELECT l_orderkey, l_linenumber, CASE WHEN min(r) IS NOT NULL THEN arg_min(mass_unit, (r, i)) END AS mass_unit, CASE WHEN min(r) IS NOT NULL THEN arg_min(density_unit, (r, i)) END AS density_unit, CASE WHEN min(r) IS NOT NULL THEN arg_min(volume_unit, (r, i)) END AS volume_unit, round(CASE WHEN min(r) IS NOT NULL THEN any_value(mass) * arg_min(x, (r, i)) END, 6) AS mass_common, CASE WHEN min(r) IS NOT NULL THEN count(*) FILTER (r <= 0.05) = 1 END AS unique
  FROM r GROUP BY n, l_orderkey, l_linenumber""")
def unit_identity(spark: SparkSession, d: str) -> DataFrame:
    """Mass = density x volume over columns in mixed units, some rows of which several combinations explain, some without a volume."""
    rows = table(spark, d, "lineitem").selectExpr(*(x.strip() for x in _MEASURED.replace("l_orderkey, l_linenumber, l_suppkey, ", "l_orderkey;l_linenumber;l_suppkey;").replace("AS mass, ", "AS mass;").replace("AS density, ", "AS density;").split(";")))
    out = resolve_units(rows.withColumns({c: F.col(c).cast("double") for c in _UNITS}), {"mass": 1, "density": -1, "volume": -1}, _UNITS)
    return out.select("l_orderkey", "l_linenumber", "mass_unit", "density_unit", "volume_unit", F.round("mass_common", 6).alias("mass_common"), "unique")


# --- streams

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT chunk_id, length(text)::INT AS chars, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "stream")
    into = sinks.Table(spark, f"{at}/table", "chunk_id")
    rows = table(spark, d, "chunks")
    ingest.upsert_stream(ingest.file_stream(spark, f"{d}/chunks.parquet", rows.schema), into, f"{at}/checkpoint", ["ingested_at"]).awaitTermination()
    return into.read().select("chunk_id", F.length("text").alias("chars"), "ingested_at")


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS new FROM events), s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
  SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "sessions")
    stream = ingest.sessions(ingest.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema), "ts", "user_id")

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("start", "end", "user_id", "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "windows")
    schema = table(spark, d, "events").schema
    stream = ingest.windowed_counts(ingest.file_stream(spark, f"{d}/events.parquet", schema), "ts", "event_type", "value")

    def batch(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("start", "event_type", "n", F.round("total", 4).alias("total"))
