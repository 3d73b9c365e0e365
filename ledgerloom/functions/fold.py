"""Folding of text to a form in which light edits of encoding and markup vanish.

Plain Python on one string, used inside Arrow-batched functions.  Every function takes None as "".
"""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that are drawn like Latin ones.
CONFUSABLES = str.maketrans(
    "абвгдеёзикмнорстухьѕіјԁһӏАВЕЅІЈКМНОРСТУХҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβγεικνορτυχωıłøđßæœ",
    "abbrдeeзnkmhopctyxbsijdhlABESIJKMHOPCTYXYABEZHIKMNOPTYXabyeiknoptuxwilodsao",
)
_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]{0,200}>")
_LINE_HYPHEN = re.compile(r"(?<=\w)[-‐‑­][ \t]*\r?\n\s*(?=[a-z])")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤⁪-⁯﻿︀-️]")
_MOJIBAKE = re.compile("[ÂÃâ][\u0080-¿€‘-™]")
_NUMBER = re.compile(r"(?<![a-z0-9])\d{1,3}(?:[,  '  ]\d{3})+(?!\d)")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+")
_ASCII = re.compile(r"[\x00-\x7f]*\Z")


def repair(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again as UTF-8; else the text itself."""
    if not _MOJIBAKE.search(text):
        return text
    for codec in ("cp1252", "latin-1"):
        try:
            return text.encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return _MOJIBAKE.sub(_repair_pair, text)


def _repair_pair(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group().encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


def unmark(text: str | None) -> str:
    """Entities resolved, tags and invisible characters gone, words broken at a line's end joined."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not _ASCII.match(text):
        text = _INVISIBLE.sub("", repair(text))
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    return text


def fold(text: str | None) -> str:
    """`unmark`, then lower case without accents, with look-alike letters as Latin ones."""
    text = unmark(text)
    if not _ASCII.match(text):
        text = unicodedata.normalize("NFKD", text.translate(CONFUSABLES))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def folded_tokens(folded: str) -> list[str]:
    """Words and numbers of a folded text; thousands separators inside a number are dropped."""
    return _TOKEN.findall(_NUMBER.sub(lambda m: re.sub(r"\D", "", m.group()), folded))


def tokens(text: str | None) -> list[str]:
    """Words and numbers of the folded text."""
    return folded_tokens(fold(text))
