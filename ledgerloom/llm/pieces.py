"""Splitting oversized texts at natural boundaries with overlap.

Method: a hierarchy of separators (section, paragraph, line, sentence, word, character).  A text is cut
recursively into atoms small enough to pack, the atoms are packed greedily up to the limit, and every
piece after the first begins with a tail of the one before.  Pieces are exact slices of the stripped
text, so the text can be put together again from `start`.

Work is one narrow pass per row: lengths are tested in the JVM, only oversized texts reach Python.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it, as a Java character class.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: From the strongest boundary to the weakest; an atom ends where the match ends.
LEVELS = (
    re.compile(r"\n(?=#{1,6} |(?:ITEM|Item) +\d{1,2}[ABC]?\b)"),
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    re.compile(r"(?:\r\n|\r|\n)\s*"),
    re.compile(r"(?<=[.!?。！？…])[\"')\]]*\s+"),
    re.compile(r"(?<=[;:,])\s+"),
    re.compile(r"\s+"),
)
_WORD_START = re.compile(r"(?<=\s)\S")


def _atoms(text: str, begin: int, end: int, most: int, level: int, out: list[int]) -> None:
    """Appends the ends of atoms of at most `most` characters that cover text[begin:end]."""
    if end - begin <= most:
        out.append(end)
        return
    if level == len(LEVELS):
        out.extend(range(begin + most, end, most))
        out.append(end)
        return
    at = begin
    for m in LEVELS[level].finditer(text, begin, end):
        if at < m.end() < end:
            _atoms(text, at, m.end(), most, level + 1, out)
            at = m.end()
    _atoms(text, at, end, most, level + 1, out)


def split(text: str | None, limit: int = 1500, overlap: int = 200) -> list[tuple[int, str]]:
    """Pieces of the stripped text as (start, piece); none for None and blank, one if it fits."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= limit:
        return [(0, text)]
    ends: list[int] = []
    _atoms(text, 0, len(text), limit - overlap, 0, ends)
    words = [m.start() for m in _WORD_START.finditer(text)]
    pieces, start, end = [], 0, 0
    for atom_end in ends:
        if atom_end - start > limit:
            pieces.append((start, text[start:end]))
            start = max(end - overlap, start + 1)
            k = bisect_left(words, start)
            if overlap and k < len(words) and words[k] <= min(end, start + max(1, overlap // 4)):
                start = words[k]
        end = atom_end
    pieces.append((start, text[start:end]))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1500, overlap: int = 200) -> DataFrame:
    """One row for each piece of every text of more than `limit` characters, white space at its ends aside.

    Columns: the key under its own name, piece_no (from 0), pieces, start (offset in the stripped text),
    n_chars, piece.  A key delivered again with the same text counts once; other columns play no part.
    Null, empty and blank texts, and texts within the limit, give no row; a null key stays a key.
    """
    schema = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    big = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    big = big.withColumn("text", F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", "")).where(F.length("text") > limit).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, n, len(parts), at, len(p), p)
                for k, t in zip(b["key"], b["text"], strict=True)
                for parts in [split(t, limit, overlap)]
                for n, (at, p) in enumerate(parts)
            ]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "pieces", "start", "n_chars", "piece"])

    out = big.mapInPandas(run, f"key {schema}, piece_no int, pieces int, start int, n_chars int, piece string")
    return out.withColumnRenamed("key", key)
