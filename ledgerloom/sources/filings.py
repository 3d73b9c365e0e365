"""Scans of filing metadata, raw pages, parsed filings, chunks, benchmark and record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Registration numbers of well-known tickers.
KNOWN_CIKS = {"NVDA": "0001045810", "AAPL": "0000320193", "MSFT": "0000789019", "GOOGL": "0001652044", "GOOG": "0001652044", "AMZN": "0001018724", "META": "0001326801", "TSLA": "0001318605", "AMD": "0000002488", "INTC": "0000050863"}

PARSED = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("fiscal_year", T.IntegerType()), T.StructField("source_file", T.StringType()), T.StructField("sections", T.MapType(T.StringType(), T.StringType())), T.StructField("character_counts", T.MapType(T.StringType(), T.IntegerType()))])
CHUNK = T.StructType([T.StructField(n, t) for n, t in (("chunk_id", T.StringType()), ("text", T.StringType()), ("ticker", T.StringType()), ("fiscal_year", T.IntegerType()), ("section", T.StringType()), ("chunk_index", T.IntegerType()), ("char_count", T.IntegerType()), ("token_count_est", T.IntegerType()))])
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("question", "answer", "context", "ticker", "filing")])
QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question", "source_company", "source_section", "answer_type", "difficulty")] + [T.StructField("fiscal_year", T.IntegerType()), T.StructField("gold_answer", T.StringType())])


def resolve_ciks(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """(ticker, cik) in upper case, the number filled up to ten digits: the fixed ones first, then the directory (ticker, cik); null if neither has it."""
    t = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    fixed = F.create_map(*(F.lit(x) for kv in KNOWN_CIKS.items() for x in kv))
    d = directory.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("listed")).groupBy("ticker").agg(F.min("listed").alias("listed"))
    return t.join(d, "ticker", "left").select("ticker", F.coalesce(F.try_element_at(fixed, F.col("ticker")), F.col("listed")).alias("cik"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings of submission files (one JSON document each, parallel arrays) as rows with pos, their place in the file."""
    arrays = ("form", "accessionNumber", "primaryDocument", "filingDate", "reportDate")
    recent = T.StructType([T.StructField(a, T.ArrayType(T.StringType())) for a in arrays])
    schema = T.StructType([T.StructField("cik", T.StringType()), T.StructField("filings", T.StructType([T.StructField("recent", recent)]))])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    zipped = F.arrays_zip(*(F.col(f"filings.recent.{a}").alias(a) for a in arrays))
    return rows.select("cik", F.posexplode(zipped).alias("pos", "f")).select("cik", "pos", *(F.col(f"f.{a}").alias(n) for a, n in zip(arrays, ("form", "accession_number", "primary_doc", "filing_date", "report_date"), strict=True)))


def annual_filings(rows: DataFrame, years: list[int] | None = None, by: str = "cik", order: str = "pos", cik: Column | None = None, base_url: str = "https://www.sec.gov/Archives/edgar/data") -> DataFrame:
    """(by, year, filing_date, report_date, accession_number, primary_doc, url): the first 10-K of each year, in source order.

    Only the form 10-K itself counts, not amendments. The year is that of the report date, else of the filing date. `cik` gives the registration number where `by` is another key.
    """
    year = F.coalesce(*(F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")) for c in ("report_date", "filing_date"))).cast("int")
    found = rows.where(F.col("form") == "10-K").withColumn("year", year).where("year is not null")
    if years is not None:
        found = found.where(F.col("year").isin(years))
    first = F.row_number().over(Window.partitionBy(by, "year").orderBy(order))
    url = F.concat_ws("/", F.lit(base_url), (cik if cik is not None else F.col(by)).cast("bigint").cast("string"), F.replace("accession_number", F.lit("-"), F.lit("")), "primary_doc")
    return found.withColumn("n", first).where("n = 1").select(by, "year", "filing_date", "report_date", "accession_number", "primary_doc", url.alias("url"))


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, fiscal_year, source_file, html) of <folder>/<ticker>/*.htm(l): the year is the first 20xx in the file's name, else 0."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{htm,html}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    year = F.coalesce(F.nullif(F.regexp_extract(name, r"(20\d\d)", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("ticker"), year.alias("fiscal_year"), name.alias("source_file"), F.decode("content", "UTF-8").alias("html"))


def parsed_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED).json(path, multiLine=True)


def chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON array, or of Parquet if the path says so."""
    return spark.read.schema(CHUNK).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(CHUNK).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def record_files(spark: SparkSession, lines: str, array: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of the JSON lines if they exist, else of the JSON array, else none."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(lines).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(lines)):
        return json_lines(spark, lines, schema)
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(array)):
        return spark.read.schema(schema).json(array, multiLine=True)
    return spark.createDataFrame([], schema)


def benchmark_file(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a document {"questions": [...]}."""
    schema = T.StructType([T.StructField("questions", T.ArrayType(QUESTION))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def matrix_file(spark: SparkSession, path: str, ids: DataFrame, block: int = 4096) -> DataFrame:
    """(chunk_id, vector) of a NumPy matrix on a path that all machines see. `ids` (pos from 0, chunk_id) says what each row stands for.

    ValueError if the matrix and `ids` have not the same number of rows; positions must be 0 to rows - 1, else rows are missing. The file
    is read in blocks where its rows are needed, never whole and never on the driver.
    """
    import numpy as np

    rows, known = np.load(path, mmap_mode="r").shape[0], ids.count()
    if rows != known:
        raise ValueError(f"{rows} vectors, {known} ids")

    def read(batches):
        m = np.load(path, mmap_mode="r")
        for b in batches:
            for at in b["at"]:
                import pandas as pd

                part = np.asarray(m[at : at + block], np.float32)
                yield pd.DataFrame({"pos": np.arange(at, at + len(part)), "vector": pd.Series(list(part), dtype=object)})

    starts = spark.range(0, max(1, rows), block).select(F.col("id").alias("at"))
    return starts.mapInPandas(read, "pos bigint, vector array<float>").join(ids.select("pos", "chunk_id"), "pos").select("chunk_id", "vector")


def result_file(spark: SparkSession, path: str) -> DataFrame:
    """(json) of a result file, for `evaluate.replayed`. FileNotFoundError that says how such a file is made if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"{path}: write it with sinks.write_json_lines(evaluate.report(...), ...) first")
    return spark.read.text(path, wholetext=True).toDF("json")
