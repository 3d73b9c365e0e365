import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.units import Grammar, extract, extract_measures, resolve_units

MEASURES = [{"measure": "rev", "label": "net revenue", "also_called": ["revenue, net of returns"], "kind": "money"}, {"measure": "water", "label": "water withdrawal", "also_called": ["water drawn"], "kind": "volume"}, {"measure": "area", "label": "leased floor area", "also_called": None, "kind": "area"}]
UNITS = [("US dollar", "money", 1.0), ("cubic metre", "volume", 1.0), ("US gallon", "volume", 0.003785411784), ("acre-foot", "volume", 1233.48183754752), ("square foot", "area", 0.09290304), ("square metre", "area", 1.0), ("acre", "area", 4046.8564224)]


@pytest.fixture(scope="module")
def grammar():
    return Grammar(MEASURES, [{"unit_name": n, "kind": k, "factor": f} for n, k, f in UNITS])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A total of USD 1,187.80 million was recorded as net revenue for the X unit.", {("rev", 1187800000)}),
        ("We reported water drawn of 766 acre-feet, compared with 35,143 cubic metres a year earlier.", {("water", 944847), ("water", 35143)}),
        ("Figures in this paragraph are given in USD million. Net revenue for 2024: 1,320.6.", {("rev", 1320600000)}),
        ("Table of net revenue (unit: $m)\nFY2022\t792.2\nFY2021\t1", {("rev", 792200000), ("rev", 1000000)}),
        ("| Measure | FY2022 | FY2021 |\n|---|---|---|\n| Leased floor area (square feet) | 65,846 | 100 |\n| Sites | 7 | 8 |", {("area", 6117), ("area", 9)}),
        ("Leased floor area rose by 144,491 sq. ft. to 62,444 m², in line with clinics.", {("area", 62444)}),
        ("Net revenue (restated) was $694,653 thousand; in fiscal 2022 it had been $5.89 billion.", {("rev", 694653000), ("rev", 5890000000)}),
        ("Water withdrawal: 106 acre-feet; Net revenue: twelve million dollars.", {("water", 130749), ("rev", 12000000)}),
        ("Leased floor area came to four hundred thousand square feet in fiscal 2021.", {("area", 37161)}),
        ("We aim to lower net revenues by 26 percent before 2032. Net revenue changed by 5% from the prior year.", set()),
        ("The yard covers 3,427 acres that we own. Net revenue is reviewed each May.", set()),
        ("Net revenue was $4.20 per share in 2018.", set()),
        ("Net revenue was 55 acres.", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_statements(grammar, text, want):
    assert extract(grammar, text) == want


def test_operator_on_odd_rows(spark):
    m = spark.createDataFrame([(r["measure"], r["label"], r["also_called"], r["kind"]) for r in MEASURES], "measure string, label string, also_called array<string>, kind string")
    u = spark.createDataFrame(UNITS, "unit_name string, kind string, factor double")
    long = "x " * 200_000 + "\n\nNet revenue: $7."
    df = spark.createDataFrame([("a", "Net revenue: $5. Net revenue: $5.", 1), ("a", "Net revenue: $5. Net revenue: $5.", 2), ("b", None, 3), ("c", "", 4), ("d", long, 5), (None, "Net revenue: $9.", 6)], "chunk_id string, text string, measure int")
    assert {tuple(r) for r in extract_measures(df, m, u).collect()} == {("a", "rev", 5), ("d", "rev", 7), (None, "rev", 9)}
    assert extract_measures(df.where(F.lit(False)), m, u).count() == 0
    assert extract_measures(df, m.where(F.lit(False)), u).count() == 0
    with pytest.raises(ValueError):
        extract_measures(df, m, u, max_definitions=2)


def test_operator_reads_every_white_space_and_case_in_labels(spark, grammar):
    m = spark.createDataFrame([(r["measure"], r["label"], r["also_called"], r["kind"]) for r in MEASURES], "measure string, label string, also_called array<string>, kind string")
    u = spark.createDataFrame(UNITS, "unit_name string, kind string, factor double")
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"Leased{b}floor{b}area totalled 100 square metres." for b in blanks] + ["Leased\xa0floor\xa0area\xa0totalled\xa0115,249\xa0sqft", "Lea\u017fed floor area: 7 square metres."]
    assert "\xa0" in blanks and "\x1c" in blanks
    want = {(i, *v) for i, t in enumerate(texts) for v in extract(grammar, t)}
    assert (len(blanks), "area", 10707) in want and (len(blanks) + 1, "area", 7) in want
    got = extract_measures(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string"), m, u)
    assert {tuple(r) for r in got.collect()} == want


def test_identity_chooses_units_and_flags_ties(spark):
    df = spark.createDataFrame([(2000.0, 2.0, 1.0), (5.0, 5.0, 1.0), (None, 1.0, 1.0), (0.0, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "mass double, density double, volume double")
    units = {"mass": {"kg": 1.0, "t": 1000.0}, "density": {"kg/m3": 1.0, "t/m3": 1000.0}, "volume": {"m3": 1.0}}
    rows = resolve_units(df, {"mass": 1, "density": -1, "volume": -1}, units).collect()
    assert (rows[0]["mass_unit"], rows[0]["density_unit"], rows[0]["unique"]) == ("kg", "t/m3", True)
    assert rows[1]["unique"] is False and rows[1]["log_residual"] == 0.0
    assert all(r["unique"] is None and r["mass_unit"] is None for r in rows[2:])
