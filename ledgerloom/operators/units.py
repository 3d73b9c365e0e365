"""Quantities stated in many units, brought to common units.

Two operators:

* `extract_measures` reads running text and tables.  A grammar finds the statements of each measure, the
  number and the unit beside it, or the unit declared by a heading, a table cell or an earlier sentence.
* `resolve_units` works on columns that obey a physical identity (mass = density x volume, say): it tries
  every combination of the columns' candidate units, takes the one with the least log residual, and flags
  rows in which a second combination fits as well.

Both are narrow: no shuffle besides the removal of repeated rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How texts write the units, beside their names. Lower case; optional points and blanks are left to `_spelling`.
SPELLINGS = {
    "US dollar": ["us dollars", "us dollar", "u.s. dollars", "dollars", "dollar", "usd", "us$", "$"],
    "square metre": ["square metres", "square metre", "square meters", "square meter", "sq m", "sqm", "m2", "m²"],
    "square foot": ["square feet", "square foot", "sq ft", "sqft", "sf", "ft2", "ft²"],
    "acre": ["acres", "acre"],
    "hectare": ["hectares", "hectare", "ha"],
    "kilowatt hour": ["kilowatt hours", "kilowatt hour", "kilowatt-hours", "kilowatt-hour", "kwh"],
    "megawatt hour": ["megawatt hours", "megawatt hour", "megawatt-hours", "megawatt-hour", "mwh"],
    "gigawatt hour": ["gigawatt hours", "gigawatt hour", "gigawatt-hours", "gigawatt-hour", "gwh"],
    "terajoule": ["terajoules", "terajoule", "tj"],
    "million British thermal units": ["million british thermal units", "million btus", "million btu", "mmbtus", "mmbtu"],
    "cubic metre": ["cubic metres", "cubic metre", "cubic meters", "cubic meter", "cu m", "cbm", "m3", "m³"],
    "litre": ["litres", "litre", "liters", "liter", "l"],
    "megalitre": ["megalitres", "megalitre", "megaliters", "megaliter", "ml"],
    "US gallon": ["us gallons", "us gallon", "gallons", "gallon", "gal"],
    "acre-foot": ["acre-feet", "acre feet", "acre-foot", "acre foot", "af"],
    "kilogram": ["kilograms", "kilogram", "kilogrammes", "kg", "kgs"],
    "tonne": ["metric tonnes", "metric tons", "metric ton", "tonnes", "tonne", "mt", "t"],
    "pound": ["pounds", "pound", "lbs", "lb"],
    "short ton": ["short tons", "short ton", "us tons"],
    "kilometre": ["kilometres", "kilometre", "kilometers", "kilometer", "km"],
    "mile": ["miles", "mile", "mi"],
}
# Units written in one word with a scale.
SCALED = {"kt": ("tonne", 1e3), "kilotonnes": ("tonne", 1e3), "kilotons": ("tonne", 1e3), "twh": ("gigawatt hour", 1e3), "gj": ("terajoule", 1e-3), "gigajoules": ("terajoule", 1e-3), "mj": ("terajoule", 1e-6), "gl": ("megalitre", 1e3), "gigalitres": ("megalitre", 1e3), "g": ("kilogram", 1e-3), "mlb": ("pound", 1e6)}
# Scale words.
SCALES = {"thousand": 1e3, "thousands": 1e3, "000s": 1e3, "'000": 1e3, "’000": 1e3, "000": 1e3, "k": 1e3, "million": 1e6, "millions": 1e6, "mn": 1e6, "mm": 1e6, "m": 1e6, "mln": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "hundred": 1e2}
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: n for n, w in enumerate(_SMALL)} | {w: 10 * (n + 2) for n, w in enumerate(_TENS)}

_NUM = r"(?:\d{1,3}(?:[,  ]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_WORDNUM = rf"(?:(?:{'|'.join(_TENS)})(?:[- ](?:{'|'.join(_SMALL[1:10])}))?|{'|'.join(sorted(_SMALL, key=len, reverse=True))})"
_SCALE = r"(?:thousands?|millions?|billions?|trillion|hundred|mln|mn|mm|bn|000s|['’]?000|k|m|b)"
_MONEY = r"(?:us\$|u\.s\.\$|usd|\$)"
# Python's \s, spelled for Java.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _spelling(word: str) -> str:
    out = re.escape(word).replace(r"\ ", r"[\s-]*" if len(word) < 6 else r"[\s-]+").replace(r"\-", r"[\s-]")
    if " " in word and len(word) < 6:
        out = r"\.?[\s-]*".join(map(re.escape, word.split(" "))) + r"\.?"
    return out


def _label_key(label: str) -> str:
    """One spelling for all that re.I takes for the same label (the long s and the dotted capital I, too)."""
    return re.sub(r"\s+", " ", label.replace("İ", "I").upper().lower())


def _unit_pattern(names: Sequence[str]) -> str:
    forms = [(f, n) for n in names for f in SPELLINGS.get(n, [n.lower()])] + [(f, n) for f, (n, _) in SCALED.items() if n in names]
    return "|".join(_spelling(f) for f, _ in sorted(forms, key=lambda x: -len(x[0])))


class Grammar:
    """The statements of the measures: compiled once for each Python worker."""

    def __init__(self, measures: Sequence[Mapping], units: Sequence[Mapping]) -> None:
        self.factor = {u["unit_name"]: (u["kind"], float(u["factor"])) for u in units}
        self.by_form: dict[str, tuple[str, float]] = {}
        for name in self.factor:
            for form in SPELLINGS.get(name, [name.lower()]):
                self.by_form[re.sub(r"[\s.\-]+", "", form)] = (name, 1.0)
        for form, (name, scale) in SCALED.items():
            if name in self.factor:
                self.by_form[form] = (name, scale)
        labels = [(label.lower(), m["measure"], m["kind"]) for m in measures for label in [m["label"], *(m["also_called"] or [])]]
        self.labels = {_label_key(label): (m, kind) for label, m, kind in labels}
        alternatives = "|".join(r"\s+".join(map(re.escape, x.split())) for x in sorted({label for label, _, _ in labels}, key=len, reverse=True))
        self.label = re.compile(rf"(?<![\w-])({alternatives})(?![\w-])", re.I)
        unit = _unit_pattern(list(self.factor))
        number = rf"(?P<n>{_NUM}|{_WORDNUM})"
        self.quantity = re.compile(
            rf"(?<![\w.,$])(?P<cur>{_MONEY})?\s*{number}(?P<s>(?:[\s-]*{_SCALE}(?![\w]))*)(?:[\s-]*(?:of\s+)?(?P<u>{unit})(?![\w²³]))?(?P<pct>\s*(?:%|per\s?cent\b|percent\b|percentage))?(?P<per>\s*(?:per|a|each)\s+(?:share|unit|tonne|employee|day|month)\b)?",
            re.I,
        )
        self.declared = re.compile(rf"^[^\w$'’]*(?:in\s+)?(?P<cur>{_MONEY})?\s*(?P<s1>{_SCALE}(?![\w]))?\s*(?:of\s+)?(?P<u>{unit})?(?![\w])\s*(?P<s2>{_SCALE}(?![\w]))?\W*$", re.I)
        self.heading = re.compile(r"\b(?:figures|amounts|values|numbers|quantities|data)\b(?:[^.\n:;|]{0,60}?\b(?:given|stated|shown|expressed|reported|presented|are|is)\s+(?:all\s+)?in|\s*,?\s*\(?\s*in)\s+(?!this\b|the\b|our\b)(?P<d>[^.\n;|)]{1,48})", re.I)

    def unit_of(self, text: str | None, kind: str) -> float | None:
        """Factor to the common unit that a declaration like "USD million" or "000 miles" stands for, if it fits the kind."""
        m = self.declared.match((text or "").strip())
        if not m or not (m["u"] or m["cur"]):
            return None
        scale = math.prod(SCALES[s.lower()] for s in (m["s1"], m["s2"]) if s)
        name, own = self.by_form[re.sub(r"[\s.\-]+", "", m["u"].lower())] if m["u"] else ("US dollar", 1.0)
        if name not in self.factor or self.factor[name][0] != kind:
            return None
        return scale * own * self.factor[name][1]

    def value(self, m: re.Match, kind: str, declared: float | None) -> Decimal | None:
        """Amount of a matched quantity in the common unit; None if it is none of this kind."""
        if m["pct"] or m["per"]:
            return None
        raw = m["n"].lower()
        if raw[0].isdigit():
            number = Decimal(re.sub(r"[,\s ]", "", raw))
        else:
            number = Decimal(sum(WORDS[w] for w in re.split(r"[- ]", raw) if w))
            if not (m["s"].strip() or m["u"] or m["cur"]):
                return None
        scale = Decimal(1)
        for word in re.split(r"[\s-]+", m["s"].strip().lower()):
            scale *= Decimal(str(SCALES.get(word, 1)))
        if m["u"]:
            name, own = self.by_form[re.sub(r"[\s.\-]+", "", m["u"].lower())]
            k, f = self.factor[name]
            if k != kind or (m["cur"] and name != "US dollar"):
                return None
            return number * scale * Decimal(repr(own * f))
        if m["cur"]:
            return number * scale if kind == "money" else None
        if declared is None or m["s"].strip():
            return None
        return number * Decimal(repr(declared))


_SHORT = re.compile(r"\b(?:sq|cu)\.[ -]?(?:ft|m|yd)\b\.?(?!\s+(?-i:[A-Z]))|\bU\.S\.(?=\s)|\b(?:sq|cu)\.[ -]?(?:ft|m)\b", re.I)
_BREAK = re.compile(r"\n[ \t]*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(*•-])")
_YEAR = re.compile(r"(?:(?:fiscal(?:\s+year)?|FY|in|for|since|by|before|the\s+year(?:\s+ended)?)\s*)?\b(?:19|20)\d\d\b(?![.,]?\d)|\bFY\s?\d\d\b", re.I)
_NO_CASE = re.compile(
    r"\b(?:aim|aims|aimed|target(?:s|ed|ing)?|goal|plan|plans|planned|intend|intends|expect(?:s|ed)?|forecast|guidance|budget(?:ed)?|commit(?:ted)?\s+to|would|may|might|could|should|will|hope|seek|propos\w+|pledg\w+|limit(?:ed)?\s+to|ceiling|cap\s+of|up\s+to|before\s+20\d\d|saved?|avoided?|reduc(?:e|ing)\b|competitor\S*|peer\S*|supplier\S*|customers?\b.{0,20}\breported|industry)\b",
    re.I,
)
_CHANGE = re.compile(r"\b(?:by|changed|change\s+of|increase\s+of|decrease\s+of|rise\s+of|fall\s+of|drop\s+of|reduction\s+of|growth\s+of|more|less|up|down|per)\s*$", re.I)
_STATES = re.compile(
    r"^(?:\s*\([^)]{0,40}\))?\s*(?:for\s+(?:the\s+)?(?:(?:fiscal\s+)?(?:year\s+)?)?|in\s+(?:fiscal\s+)?)?\s*(?:,?\s*at\s+all\s+sites)?\s*"
    r"(?::|=|-|–|—|\bof\b|\bwas\b|\bwere\b|\bis\b|\bstood\s+at\b|\bamounted\s+to\b|\bcame\s+to\b|\bcame\s+in\s+at\b|\btotall?ed\b|\breached\b|\bequall?ed\b|\bmeasured\b|\bran\s+to\b|\bat\b|\bto\b)", re.I)
_MOVED = re.compile(r"^(?:\s*\([^)]{0,40}\))?\s*(?:has\s+|had\s+)?(?:\w+ly\s+)?(?:increased|decreased|rose|fell|grew|declined|climbed|dropped|advanced|slipped|improved|weakened|recovered|narrowed|went|moved|changed|expanded|shrank|was\s+(?:up|down))\b", re.I)


def _blank_years(text: str) -> str:
    return _YEAR.sub(lambda m: re.sub(r"\d", "x", m.group()), text)


def _round(x: Decimal) -> int:
    return int(x.quantize(Decimal(1), rounding=ROUND_HALF_UP))


def extract(grammar: Grammar, text: str | None) -> set[tuple[str, int]]:
    """(measure, amount) for each value the text states; an empty set for None and blank."""
    found: set[tuple[str, int]] = set()
    if not text or not grammar.label.search(text):
        return found
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").replace("​", "")
    text = _SHORT.sub(lambda m: m.group().replace(".", ""), text)
    for block in _BREAK.split(text):
        heading = None
        if m := grammar.heading.search(block):
            heading = m["d"]
        if not grammar.label.search(block):
            continue
        lines = block.split("\n")
        if any(line.count("|") >= 2 for line in lines):
            _table(grammar, lines, heading, found)
        if _keyed_table(grammar, lines, heading, found):
            continue
        prose = re.sub(r"[ \t]*\n[ \t]*", " ", "\n".join(x for x in lines if x.count("|") < 2))
        for sentence in _SENTENCE.split(prose):
            if m := grammar.heading.search(sentence):
                heading = m["d"]
            _sentence(grammar, sentence, heading, found)
    return found


def _add(grammar: Grammar, cell: str, measure: str, kind: str, declared: float | None, found: set) -> None:
    m = grammar.quantity.search(_blank_years(cell))
    if m and (v := grammar.value(m, kind, declared)) is not None:
        found.add((measure, _round(v)))


def _table(grammar: Grammar, lines: list[str], heading: str | None, found: set) -> None:
    """Rows between bars: the label in a cell, its unit in brackets, in another cell or in the header."""
    header: list[str] = []
    for line in lines:
        if line.count("|") < 2:
            if m := grammar.heading.search(line):
                heading = m["d"]
            continue
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if all(re.fullmatch(r":?-*:?", c) for c in cells):
            continue
        m = grammar.label.match(cells[0].lstrip("*_ ")) if cells else None
        if not m:
            header = header or cells
            continue
        measure, kind = grammar.labels[_label_key(m[1])]
        rest = cells[0].lstrip("*_ ")[m.end() :]
        places = [*re.findall(r"[(\[]([^)\]]*)[)\]]", rest), rest.strip(" ,:-*_"), *cells[1:], *(x for h in header for x in [h, *re.findall(r"\(([^)]*)\)", h)]), heading]
        declared = next((u for p in places if (u := grammar.unit_of(p, kind)) is not None), None)
        for k, cell in enumerate(cells[1:], 1):
            if re.search(r"change|%|target|goal|growth|variance|plan", header[k] if k < len(header) else "", re.I):
                continue
            if not re.fullmatch(r"(?:19|20)\d\d", cell):
                _add(grammar, cell, measure, kind, declared, found)


def _keyed_table(grammar: Grammar, lines: list[str], heading: str | None, found: set) -> bool:
    """A caption with label and unit, then lines of a year and a value. True if the block is one."""
    inside = None
    for line in lines:
        caption = re.match(r"\W*(?:table|schedule|summary|overview)\b", line, re.I)
        m = grammar.label.search(line) if caption else None
        if m:
            measure, kind = grammar.labels[_label_key(m[1])]
            units = re.findall(r"[(\[]\s*(?:units?\s*(?:of\s+measure)?\s*[:=]\s*|in\s+)?([^)\]]*)[)\]]", line[m.end() :], re.I)
            declared = next((u for p in [*units, heading] if (u := grammar.unit_of(p, kind)) is not None), None)
            inside = (measure, kind, declared)
        elif inside and (m := re.match(r"\W*(?:FY\s?|fiscal\s+)?(?:19|20)?\d\d\b\s*[\t:;=,|]?\s*(.+)", line, re.I)):
            _add(grammar, m[1], *inside, found)
    return inside is not None


def _sentence(grammar: Grammar, sentence: str, heading: str | None, found: set) -> None:
    labels = list(grammar.label.finditer(sentence))
    if not labels:
        return
    if _NO_CASE.search(grammar.label.sub(" ", sentence)) and not re.search(r"\bwe\s+reported\b", sentence, re.I):
        return
    masked = _blank_years(sentence)
    quantities = list(grammar.quantity.finditer(masked))
    for k, label in enumerate(labels):
        measure, kind = grammar.labels[_label_key(label[1])]
        end = labels[k + 1].start() if k + 1 < len(labels) else len(sentence)
        declared = grammar.unit_of(heading, kind)
        after = masked[label.end() : end]
        if m := re.match(r"\s*\((?:in\s+|unit:\s*)?([^)]*)\)", after):
            declared = grammar.unit_of(m[1], kind) or declared
        before = re.search(r"\b(?:recorded|reported|booked|stated|shown|counted|disclosed|measured)\s+as\s+(?:the\s+|our\s+|total\s+)?$", masked[: label.start()], re.I)
        if before:
            lead = [q for q in quantities if q.end() <= before.start()]
            if lead and (v := grammar.value(lead[-1], kind, declared)) is not None:
                found.add((measure, _round(v)))
            continue
        moved = _MOVED.match(after)
        if not moved and not _STATES.match(re.sub(r"(?:fiscal\s+|FY\s?)?x{2,4}", "", after, flags=re.I)):
            continue
        for q in quantities:
            if not label.end() <= q.start() < end:
                continue
            gap = masked[label.end() : q.start()]
            lead = gap[-24:]
            if _CHANGE.search(lead) or (moved and not re.search(r"\b(?:to|from|at|was|were|been)\s*$", lead, re.I)):
                continue
            if re.search(r"[.;]\s", gap) and not re.search(r"\b(?:it|this|that|they|the\s+(?:prior|previous|year-earlier|comparative)\s+\w+)\s+(?:(?:had|has|have)\s+(?:been|stood|come|reached)|was|were|stood|came|amounted|totall?ed)\b[^.;]*$", gap, re.I):
                continue
            if (v := grammar.value(q, kind, declared)) is not None:
                found.add((measure, _round(v)))


def extract_measures(chunks: DataFrame, measures: DataFrame, units: DataFrame, key: str = "chunk_id", text: str = "text", max_definitions: int = 10_000) -> DataFrame:
    """Distinct (key, measure string, amount bigint): every value a text states for a measure, in its common unit.

    `measures` and `units` are definitions, not data: they go to the driver, and more than `max_definitions`
    of either raise ValueError.  Null, empty and blank texts, texts of any length without a statement, and an
    empty table give no row; repeated rows and equal values give one; other columns play no part.  A value
    whose unit cannot be found, or is of another kind than the measure, gives no row.
    """
    m = measures.select("measure", "label", "also_called", "kind").limit(max_definitions + 1).collect()
    u = units.select("unit_name", "kind", "factor").limit(max_definitions + 1).collect()
    if max(len(m), len(u)) > max_definitions:
        raise ValueError(f"more than {max_definitions} measures or units")
    rows = [r.asDict() for r in m], [r.asDict() for r in u]
    words = sorted({w for r in m for w in [r["label"], *(r["also_called"] or [])]})
    schema = chunks.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    if not words:
        return chunks.select(F.col(key), F.lit("").alias("measure"), F.lit(0).cast("bigint").alias("amount")).limit(0)
    # must let through all that `Grammar.label` matches: letters and white space as Python reads them, not as Java's default does
    named = "(?iu)" + "|".join(f"{_BLANK}+".join(re.sub(r"([^\w])", r"\\\1", p) for p in w.split()) for w in words)
    rest = chunks.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(named))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(*rows)
        for b in batches:
            out = [(k, measure, amount) for k, t in zip(b["key"], b["text"], strict=True) for measure, amount in extract(grammar, t)]
            yield pd.DataFrame(out, columns=["key", "measure", "amount"])

    return rest.mapInPandas(run, f"key {schema}, measure string, amount bigint").distinct().withColumnRenamed("key", key)


def resolve_units(df: DataFrame, identity: Mapping[str, int], candidates: Mapping[str, Mapping[str, float]], tolerance: float = 0.05) -> DataFrame:
    """Units of columns tied by a product identity, by the least log residual.

    `identity` gives each column's exponent, so that the product of value ** exponent is 1 in common units:
    mass = density x volume is {"mass": 1, "density": -1, "volume": -1}.  `candidates` gives each column's units
    with the factor to its common unit.  Adds <column>_unit and <column>_common for each column, log_residual, and
    unique: false if another combination with other common values has a residual within `tolerance` of the best.
    Residuals are compared to nine digits, ties go to the first combination.  A row with a value that is null, not finite or not positive gets nulls; an empty table stays empty.
    All is JVM-side: one literal array of combinations, no shuffle, so rows of one hot key do no harm.
    """
    names = list(identity)
    combos = list(itertools.product(*(candidates[n].items() for n in names)))
    if len(combos) > 100_000:
        raise ValueError("too many combinations of units")
    shift = [sum(identity[n] * math.log(f) for n, (_, f) in zip(names, c, strict=True)) for c in combos]
    usable = F.lit(True)
    base = F.lit(0.0)
    for n in names:
        v = F.col(n).cast("double")
        usable = usable & F.coalesce((v > 0) & (v < float("inf")) & ~F.isnan(v), F.lit(False))
        base = base + identity[n] * F.log(F.when(v > 0, v))
    scored = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(combos) - 1)), lambda i: F.struct(F.round(F.abs(base + F.element_at(F.array(*map(F.lit, shift)), i + 1)), 9).alias("r"), i.alias("i"))))
    out = df.withColumn("__scored", F.when(usable, scored))
    best = F.col("__scored")[0]
    for k, n in enumerate(names):
        units = F.array(*(F.lit(c[k][0]) for c in combos))
        factors = F.array(*(F.lit(float(c[k][1])) for c in combos))
        at, found = F.coalesce(best["i"], F.lit(0)) + 1, F.col("__scored").isNotNull()
        out = out.withColumn(f"{n}_unit", F.when(found, F.element_at(units, at))).withColumn(f"{n}_common", F.when(found, F.col(n).cast("double") * F.element_at(factors, at)))
    close = F.size(F.filter("__scored", lambda x: x["r"] <= best["r"] + tolerance))
    return out.withColumn("log_residual", best["r"]).withColumn("unique", F.when(F.col("__scored").isNotNull(), close == 1)).drop("__scored")
