"""Prompts, chat rendering and training targets as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank, has_citation, source_block, strip

# Tokens of the public chat template, and the text of a refusal.
BEGIN, HEAD, HEAD_END, TURN_END = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
REFUSAL = "I could not find sufficient information in the retrieved 10-K passages to answer this question."
RULE = "=" * 57
EMPTY_CONTEXT = "No relevant filing passages found."
#: Own wording; callers may give another.
SYSTEM = (
    "You answer questions about annual filings from the numbered passages of the context and from nothing else.\n"
    "Give the tag of the passage, such as [SOURCE 1], behind every statement.\n"
    "Keep figures, units and years as they are printed.\n"
    f'If the passages do not hold the answer, reply exactly: "{REFUSAL}"'
)


def user_content(question: Column, context: Column) -> Column:
    return F.concat(strip(context), F.lit("\n\nQuestion: "), strip(question), F.lit("\nAnswer:"))


def messages(question: Column, context: Column, system: str = SYSTEM) -> Column:
    """System and user turn as array<struct<role, content>>; a blank question raises."""
    asked = F.when(blank(question), F.raise_error(F.lit("the question is blank")).cast("string")).otherwise(question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user_content(asked, context).alias("content")))


def render_chat(turns: Column, open_answer: bool = False) -> Column:
    """The turns as one chat string; with `open_answer` an assistant's header ends it."""
    parts = F.transform(turns, lambda m: F.concat(F.lit(HEAD), m["role"], F.lit(f"{HEAD_END}\n\n"), strip(F.coalesce(m["content"], F.lit(""))), F.lit(TURN_END)))
    return F.concat(F.lit(BEGIN), F.array_join(parts, ""), F.lit(f"{HEAD}assistant{HEAD_END}\n\n" if open_answer else ""))


def prompt(question: Column, context: Column, system: str = SYSTEM) -> Column:
    return render_chat(messages(question, context, system), True)


def training_target(answer: Column, sources: tuple[int, ...] = (1,)) -> Column:
    """A blank answer becomes the refusal, a cited one stays, any other gets the sources' tags."""
    text = strip(F.coalesce(answer, F.lit("")))
    tags = " ".join(f"[SOURCE {i}]" for i in sources)
    return F.when(text == "", REFUSAL).when(has_citation(text), text).otherwise(strip(F.concat(text, F.lit(f" {tags}"))))


def cited_answer(answer: Column) -> Column:
    """A model's answer made to cite: blank as refusal, uncited with the first source."""
    return training_target(answer, (1,))


def training_context(ticker: Column, year: Column, section: Column, text: Column) -> Column:
    """Context of one training passage."""
    return F.concat(F.lit("=== RETRIEVED 10-K CONTEXT (1 passage) ===\n\n"), source_block(F.lit(1), ticker, year, section, F.lit(1.0), text), F.lit(RULE))


def training_messages(question: Column, context: Column, answer: Column, system: str = SYSTEM) -> Column:
    turn = F.array(F.struct(F.lit("assistant").alias("role"), training_target(answer).alias("content")))
    return F.concat(messages(question, context, system), turn)
