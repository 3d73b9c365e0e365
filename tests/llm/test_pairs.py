import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.pairs import SuffixAutomaton, copied, defect, find_defects

CONTEXT = "Ardovia bought Quelmont for $12.5 million in 2019 to gain access to coastal vaults in Torby. A shortage of idle looms in Kel could delay Torvex Valve."


@pytest.mark.parametrize(
    ("question", "answer", "want"),
    [
        ("Why did Ardovia buy Quelmont?", None, "empty_answer"),
        ("Why did Ardovia buy Quelmont?", " \n", "empty_answer"),
        ("Why did Ardovia buy Quelmont?", "N/A", "empty_answer"),
        ("Why did Ardovia buy Quelmont?", "[no answer]", "empty_answer"),
        ("Why did Ardovia buy Quelmont in 2019?", "You asked: why did Ardovia buy Quelmont in 2019?", "copies_question"),
        ("Why did Ardovia buy Quelmont in 2019?", "why did ardovia by Quelmont in 2019.", "copies_question"),
        ("Why did Ardovia buy Quelmont?", "I'm sorry, but I can't help with that.", "refusal"),
        ("Why did Ardovia buy Quelmont?", "Ich kann diese Frage nicht beantworten.", "refusal"),
        ("Why did Ardovia buy Quelmont?", "Ardovia cannot predict the outcome of the claim and has set aside $12.5 million for it.", None),
        ("Why did the sales of the unit rise?", "Der Absatz stieg, weil die Kunden neue Aufträge vergeben haben.", "other_language"),
        ("Warum stieg der Absatz von Torvex im Jahr 2017?", "Der Absatz stieg, weil die Kunden neue Aufträge vergeben haben.", None),
        ("Why did Ardovia buy Quelmont?", "Ardovia bought Quelmont because it wanted access to coast", "truncated_answer"),
        ("Why did Ardovia buy Quelmont?", "Ardovia bought Quelmont for $12.5 million because", "truncated_answer"),
        ("Why did Ardovia buy Quelmont?", "Ardovia bought Quelmont for (among others", "truncated_answer"),
        ("Why did Ardovia buy Quelmont?", "Ardovia bought Quelmont to gain...", "truncated_answer"),
        ("Which shortage?", "A shortage of idle looms in Kel", None),
        ("What was paid?", "$12.5 million", None),
        ("Why did Ardovia buy Quelmont?", "Ardovia bought Quelmont because it wanted access to coastal vaults in Torby", None),
        (None, "It rose.", None),
        ("", "", "empty_answer"),
    ],
)
def test_defects(question, answer, want):
    assert defect(question, answer, CONTEXT) == want


def test_automaton_against_brute_force():
    a, b = "a b a b c a".split(), "b a b c x a b".split()

    def longest(end):
        return max(n for n in range(end + 1) if n == 0 or any(a[i : i + n] == b[end - n : end] for i in range(len(a))))

    assert SuffixAutomaton(a).matches(b) == [longest(k) for k in range(1, len(b) + 1)]
    assert copied(a, b) == 6 / 7 and copied([], b) == 0 and copied(a, []) == 0


def test_operator(spark):
    rows = [(1, "q", None, None), (1, "q", None, None), (2, None, None, None), (3, None, "fine.", None), (4, "x " * 100_000, "y " * 100_000 + "end.", None)]
    df = spark.createDataFrame(rows, "qa_id bigint, question string, answer string, context string").withColumn("defect", F.lit("x")).withColumn("key", F.lit("y"))
    assert {tuple(r) for r in find_defects(df, "qa_id", "question", "answer", "context").collect()} == {(1, "empty_answer"), (2, "empty_answer")}
    assert find_defects(df.where(F.lit(False)), "qa_id", "question", "answer").count() == 0


def test_refusals_in_other_words_and_copies_in_other_number_format():
    assert defect("What did X earn?", "I have no access to data on bonds and cannot respond.") == "refusal"
    assert defect("Warum stieg der Absatz?", "Dazu kann ich leider keine Auskunft geben.") == "refusal"
    assert defect("What was the purpose of buying Zan for $84,230,490?", "what was the purpose of buying zan for $84230490") == "copies_question"
    assert defect("Does the text say so?", "The text says that sales rose.") is None
