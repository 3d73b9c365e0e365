"""Text functions as native column expressions: all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: question words and fillers that carry no meaning for sentence matching.
QUERY_STOPWORDS = ("what", "were", "much", "does", "from", "total", "year", "fiscal")
# Patterns of the text contract.
CITATION = r"\[SOURCE\s+\d+\]"
#: Word boundaries are spelled out by Unicode letters and numbers, as engines differ in what their own boundary sees.
_WORD = r"[\p{L}\p{N}_]"
FINANCE_TOKEN = rf"(?:(?<!{_WORD})(?=[A-Za-z0-9_])|(?<={_WORD})(?=[$%.-]))[A-Za-z0-9_$%.-]+(?:(?<=[A-Za-z0-9_])(?!{_WORD})|(?<=[$%.-])(?={_WORD}))"
SENTENCE_END = r"(?<=[.!?])\s+"
LINE_OR_SENTENCE_END = r"(?<=[.!?\n])\s+"
NUMERIC_FACT = r"([A-Z][A-Za-z0-9 ,\-']{4,70}?)\s+(?:was|were|totaled|totalled|reached|increased|decreased|grew|of|by)\s+(\$?\d[\d,\.]*\s*(?:billion|million|trillion|%)?)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (`trim` takes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Whether a text is null or has nothing but white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def finance_tokens(c: Column) -> Column:
    """Lower-case tokens that keep inner $ % . - ; leading and trailing points and hyphens are cut, empty tokens dropped."""
    found = F.regexp_extract_all(F.lower(c), F.lit(FINANCE_TOKEN), 0)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^[.-]+|[.-]+$", "")), lambda x: x != "")


def normalize_text(c: Column) -> Column:
    """Lower-case letters and digits, runs of anything else as one space; null as empty."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), " ")


def token_set(c: Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def filing_year(*texts: Column, number: Column | None = None) -> Column:
    """First year found: `number` if it lies in 2000..2099, else the first 19xx or 20xx in each text in turn."""
    from_text = [F.nullif(F.regexp_extract(t.cast("string"), r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int") for t in texts]
    own = [F.when(number.between(2000, 2099), number.cast("int"))] if number is not None else []
    return F.coalesce(*own, *from_text)


def record_section(section: Column, source_section: Column | None = None, default: str = "10-K") -> Column:
    """First section that is not empty, stripped."""
    given = [strip(F.nullif(c, F.lit(""))) for c in (section, source_section) if c is not None]
    return F.coalesce(*given, F.lit(default))


# What a free-form section name has to contain to mean an item.
SECTION_RULES = (
    ("item_7", ("item 7", "management's discussion", "md&a", "results of operations", "segment", "liquidity", "key metrics", "performance")),
    ("item_8", ("item 8", "balance sheet", "cash flow", "taxes", "business combination", "notes to financial")),
)


def canonical_sections(c: Column) -> Column:
    """Items that a free-form section name means, the main one first; item_7 if none is recognised."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(s, F.lit(w))
        return out

    income = has("operations", "income", "revenue")
    found = [
        F.when(has("1a", "risk"), "item_1a"),
        F.when(has("item 1 ", "business overview", "human capital", "employee") & ~has("1a"), "item_1"),
        *(F.when(has(*words), item) for item, words in SECTION_RULES),
        F.when(income, "item_7"),
        F.when(income, "item_8"),
    ]
    kept = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("item_7")))


def guess_section(c: Column) -> Column:
    """Item whose heading stands anywhere in the text, item 8 before 7 before 1A before 1; unknown if none."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("item 8")), "item_8").when(F.contains(low, F.lit("item 7")), "item_7").when(F.contains(low, F.lit("item 1a")), "item_1a").when(F.contains(low, F.lit("item 1")), "item_1").otherwise("unknown")


def sentences(c: Column, pattern: str = SENTENCE_END) -> Column:
    return F.split(c, pattern)


def numeric_fact(sentence: Column) -> Column:
    """struct(label, value) of the first labelled figure of a sentence; empty strings if there is none."""
    return F.struct(F.regexp_extract(sentence, NUMERIC_FACT, 1).alias("label"), F.regexp_extract(sentence, NUMERIC_FACT, 2).alias("value"))


def extractive_question(label: Column, ticker: Column, year: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(label, r"\s+", " "), r"^[ ,-]+|[ ,-]+$", "")
    return F.format_string("What does %s report regarding %s in its FY%s 10-K?", ticker, clean, year.cast("string"))


def has_citation(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(CITATION)), F.lit(False))


def citations(c: Column) -> Column:
    """All source tags in order, repeated ones kept."""
    return F.regexp_extract_all(c, F.lit(CITATION), 0)


def excerpt(c: Column, size: int = 200) -> Column:
    return strip(F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" ")))


def source_header(index: Column, ticker: Column, year: Column, section: Column, score: Column) -> Column:
    return F.format_string("[SOURCE %s | %s FY%s %s | Score: %.4f]", index.cast("string"), ticker, year.cast("string"), section, score.cast("double"))


def source_block(index: Column, ticker: Column, year: Column, section: Column, score: Column, text: Column) -> Column:
    return F.concat(source_header(index, ticker, year, section, score), F.lit("\n"), strip(text), F.lit("\n"))


def metric_key(c: Column, kind: str) -> Column:
    """Name of a breakdown group inside a metric's name; `kind` is type or co."""
    return F.lower(F.translate(c, " /" if kind == "type" else " ", "__" if kind == "type" else "_"))


def mode_label(hybrid: bool, rerank: bool) -> str:
    return "+".join(["dense", *["bm25"] * hybrid, *["rerank"] * rerank])
