from pyspark.sql import functions as F

from ledgerloom.functions import prompts, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_jaccard(spark):
    assert one(spark, text.normalize_text(F.lit("  What's Up, 10-K? "))) == "what s up 10 k"
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) == ""
    sets = [(["a", "b"], ["b", "c"], 1 / 3), (["a"], ["a"], 1.0), ([], [], 0.0)]
    for a, b, want in sets:
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        assert abs(df.select(text.jaccard(F.col("a"), F.col("b"))).first()[0] - want) < 1e-12


def test_filing_year(spark):
    assert one(spark, text.filing_year(F.lit("2024_10K"))) == 2024
    assert one(spark, text.filing_year(F.lit("none"))) is None
    assert one(spark, text.filing_year(F.lit("FY2021"), number=F.lit(2023))) == 2023
    assert one(spark, text.filing_year(F.lit("FY2021"), number=F.lit(1850))) == 2021


def test_finance_tokens(spark):
    assert one(spark, text.finance_tokens(F.lit("Sales of $391.0 rose 22% to 1,234 (a$b) -x- ..."))) == ["sales", "of", "391.0", "rose", "22", "to", "1", "234", "a$b", "x"]


def test_canonical_sections(spark):
    cases = {"Item 1A": ["item_1a"], "Item 1 - Business": ["item_1"], "Item 1": ["item_7"], "Results of Operations": ["item_7", "item_8"], "Balance Sheet": ["item_8"], "?": ["item_7"]}
    for name, want in cases.items():
        assert one(spark, text.canonical_sections(F.lit(name))) == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip(F.lit(" \t\n a b  \r\n"))) == "a b"
    assert one(spark, text.blank(F.lit("\n "))) is True


def test_questions_headers_and_keys(spark):
    assert one(spark, text.extractive_question(F.lit(" Net  revenue ,-"), F.lit("AB"), F.lit(2023))) == "What does AB report regarding Net revenue in its FY2023 10-K?"
    assert one(spark, text.source_header(F.lit(2), F.lit("AB"), F.lit(2023), F.lit("item_7"), F.lit(0.8255))) == "[SOURCE 2 | AB FY2023 item_7 | Score: 0.8255]"
    assert one(spark, text.metric_key(F.lit("Multi Hop/Table"), "type")) == "multi_hop_table"
    assert one(spark, text.metric_key(F.lit("A/B Co"), "co")) == "a/b_co"
    assert text.mode_label(True, True) == "dense+bm25+rerank"


def test_training_target_and_chat(spark):
    for answer, want in (("It rose.", "It rose. [SOURCE 1]"), ("It rose [SOURCE 3].", "It rose [SOURCE 3]."), ("  ", prompts.REFUSAL), (None, prompts.REFUSAL)):
        assert one(spark, prompts.training_target(F.lit(answer).cast("string"))) == want
    rows = spark.createDataFrame([("Why?", "ctx")], "q string, c string")
    chat = rows.select(prompts.prompt(F.col("q"), F.col("c"))).first()[0]
    assert chat.startswith(prompts.BEGIN) and chat.endswith(f"{prompts.HEAD}assistant{prompts.HEAD_END}\n\n") and "Question: Why?\nAnswer:" in chat


def test_blank_question_raises(spark):
    import pytest

    rows = spark.createDataFrame([(" ", "ctx")], "q string, c string")
    with pytest.raises(Exception, match="blank"):
        rows.select(prompts.prompt(F.col("q"), F.col("c"))).collect()
