import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.abuse import CLASSES, MACHINE, PATTERNS, THRESHOLD, clause_weight, rates, score, score_texts, undisguise

BAD = [
    ("You are a worthless moron.", "insult"), ("What a p-a-t-h-e-t-i-c i.m.b.e.c.i.l.e, go cry.", "insult"), ("Piss off, you gutless m o r o n.", "insult"), ("You filthy little b*****d.", "insult"),
    ("You are a stupid іdіоt.", "insult"), ("This is bull5h17 and you lying l053r5 should r07.", "insult"), ("Halt die Fresse, du Drecksack.", "insult"), ("Tu n'es qu'un pauvre connard.", "insult"), ("Cállate la boca, pedazo de basura.", "insult"),
    ("I will find where you live and make you pay.", "threat"), ("Why don't you just die?", "threat"), ("Ich schlag dir die Zähne aus.", "threat"), ("The Zorvians are vermin and should be driven out.", "hate"), ("Keep the Harbour people away from decent folk, they are subhuman.", "hate"),
    ("Hot naked girls near you, uncensored xxx clips.", "sexual"), ("Send n​u​d​e​s first, sexy.", "sexual"), ("Chicas desnudas quieren sexo esta noche.", "sexual"),
]
CLEAN = [
    "That was a stupid price to pay, in my opinion.", "Naked short selling of our shares may depress the price.", "The rat and vermin control contract was renewed.", "Our sexual harassment policy was updated and staff were trained.", "The clinic treats sexually transmitted infections.",
    "Bastard files and dumb terminals were retired.", "The kill switch stops the pump at once.", "The slaughter line was idle and animals were moved.", "Moderators removed 51 posts for hate speech and nudity.", "Honestly a terrible quarter, I sold all my shares.", "You are wrong, look at the cash flow first.", "A claim of sex discrimination was dismissed.", "", None, " \n",
]


@pytest.mark.parametrize(("text", "kind"), BAD)
def test_abuse_is_scored(text, kind):
    s, k = score("Sales rose by 5 percent. " + text)
    assert s >= THRESHOLD and k == kind


@pytest.mark.parametrize("text", CLEAN)
def test_sober_texts_are_not(text):
    assert score(text)[0] < THRESHOLD


@pytest.mark.parametrize("text", ["FCUK you and your forecast.", "The clown who wrote this note about Ardtav Clinic Portal is a complete cretin.", "You idoit."])
def test_swapped_letters_and_names_hide_nothing(text):
    assert score(text)[0] >= THRESHOLD


UNLISTED = ["I know where you sleep.", "We will come for you.", "I will cut his throat", "He needs to be shot.", "kys", "Drown, all of you", "I would shag her", "nice rack", "He was jerking off to her photo", "gets turned on when", "Back to where you came from", "Ich finde dich", "que te follen"]


@pytest.mark.parametrize("text", UNLISTED)
def test_clauses_without_a_listed_word_are_scored(text):
    assert clause_weight(text)[0] >= 0.8


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_every_alternative_of_every_pattern_is_read(k):
    kind, weight, pattern = PATTERNS[k]
    first = {name: sorted(words)[0] for name, words in CLASSES.items()}
    items = []
    for item in pattern.split():
        if item[0] != "~":
            items.append([["" if x in "^$" else first[x[1:-1]] if x[0] == "<" else x.removesuffix("+") for x in alternative.split("_")] for alternative in item.rstrip("?*").split("|")] or [[]])
    for n, alternatives in enumerate(items):
        for own in alternatives:
            words = [w for m, other in enumerate(items) for w in (own if m == n else other[0]) if w]
            assert MACHINE.run(words).get(kind, 0) >= weight, words


def test_undisguise():
    assert undisguise("m.o.r.o.n 5ubhum4n moooorons b*****d") == "moron subhuman morons bastard".split()


def test_operator(spark):
    rows = [(1, BAD[0][0], "a", 9.0), (1, BAD[0][0], "a", 9.0), (2, None, "a", 9.0), (3, "", None, 9.0), (4, "fine words here. " * 20_000 + BAD[0][0], None, 9.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double").withColumn("key", F.lit("k"))
    out = score_texts(df, "doc_id", "text", "source")
    assert out.count() == 5 and {r["doc_id"] for r in out.where(F.col("score") >= THRESHOLD).collect()} == {1, 4}
    by = {r["source"]: r for r in rates(out, "source").collect()}
    assert by["a"]["abusive"] == 2 and by["a"]["documents"] == 3 and by[None]["rate"] == 0.5
    assert score_texts(df.where(F.lit(False)), "doc_id", "text").count() == 0
