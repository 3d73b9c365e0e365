import datetime as dt

from ledgerloom.sources.sinks import Table
from ledgerloom.streaming import ingest


def test_upsert_stream(spark, tmp_path):
    schema = "k int, v string, o int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema).write.parquet(str(tmp_path / "in"))
    t = Table(spark, str(tmp_path / "t"), "k")
    df = spark.read.parquet(str(tmp_path / "in"))

    def run():
        ingest.upsert_stream(ingest.file_stream(spark, str(tmp_path / "in"), df.schema), t, str(tmp_path / "c"), ["o"]).awaitTermination()

    run()
    spark.createDataFrame([(2, "x", 1), (1, "c", 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert {tuple(r) for r in t.read().collect()} == {(1, "c", 3), (2, "x", 1)}


def test_windows_and_sessions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), "u", 1.0) for m in (0, 5, 70, 200)]
    spark.createDataFrame(rows, "ts timestamp, u string, x double").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    for f, name, want in ((lambda s: ingest.windowed_counts(s, "ts", "u", "x"), "w", [2, 1, 1]), (lambda s: ingest.sessions(s, "ts", "u"), "s", [2, 1, 1])):
        q = f(ingest.file_stream(spark, str(tmp_path / "e"), schema)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [r["n"] for r in spark.sql(f"select n from {name} order by start").collect()] == want
