"""Evaluation texts that leak into training records.

Method: suffix arrays of the training text.  Each shard of records gets a suffix array over its words; every
suffix of every test text is looked up in it by binary search and extended to its longest verbatim matches, with
their places.  Verbatim matches that hold enough distinctive words mark a record and an item as candidates; an
alignment of the item's question or sentences with the words around these places then decides, so that light
edits do not hide a leak and the same wording about other names does not make one.

Which words are distinctive is settled once, by counts over all test items, so it does not depend on blocks.

Scale: one scan of the records whatever the number of items.  The items reach the tasks in blocks of at most
`block` items, and a worker holds one block at a time.  Occurrences of a frequent run of words are extended in
slices of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fold import tokens
from ledgerloom.llm.pairs import _near

ANCHOR = 3
#: Words of a shard: suffix arrays of this size take a few MB.
SHARD = 150_000
#: Occurrences of test suffixes that are extended at once.
SLICE = 1_000_000
_NOISE = frozenset("us usd dollars dollar percent per cent pct".split())
_SCALE = {"thousand": 3, "million": 6, "mn": 6, "billion": 9, "bn": 9, "trillion": 12}
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def words(text: str | None) -> list[str]:
    """Words of a text with numbers in one format: scale words are multiplied in, currency and per cent words dropped."""
    out: list[str] = []
    for w in tokens(re.sub(r"(?i)\bU\.S\.|US\$", "$", text) if text else text):
        if w in _SCALE and out and out[-1][0].isdigit():
            whole, _, part = out[-1].partition(".")
            if len(part) <= _SCALE[w]:
                out[-1] = (whole + part + "0" * (_SCALE[w] - len(part))).lstrip("0") or "0"
        elif w not in _NOISE:
            out.append(w[:-2] if w.endswith(".0") else w)
    return out


def suffix_array(codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions sorted by their suffixes, by prefix doubling; with `depth` the order counts that many codes at least."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h = 1
    while n > 1 and rank[order[-1]] < n - 1 and (depth is None or h < depth):
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(in_order[1:] != in_order[:-1])))
        h *= 2
    return order


def common_share(n: int, share: float = 0.05) -> int:
    """In how many of n items a word may stand to be distinctive."""
    return max(1, int(share * n))


class Items:
    """A block of test items prepared for lookup: their texts as words, the words' codes, and which words are distinctive."""

    def __init__(self, rows: Sequence[tuple[int, str | None, str | None]], common: frozenset[str]) -> None:
        self.ids = [r[0] for r in rows]
        self.questions = [words(q) for _, q, _ in rows]
        self.sentences = [[w for s in _SENTENCE.split(p or "") if (w := words(s))] for _, _, p in rows]
        self.passages = [[w for s in ss for w in s] for ss in self.sentences]
        self.distinct = [{w for w in {*q, *p} if w not in common or (w[0].isdigit() and len(w) > 4)} for q, p in zip(self.questions, self.passages, strict=True)]
        self.code: dict[str, int] = {}
        codes, owner, special = [], [], []
        for k in range(len(rows)):
            for ws in (self.questions[k], self.passages[k]):
                codes += [self.code.setdefault(w, len(self.code) + 2) for w in ws] + [1]
                owner += [k] * (len(ws) + 1)
                special += [w in self.distinct[k] for w in ws] + [False]
        self.test, self.owner, self.special = np.array(codes, np.int64), np.array(owner, np.int64), np.array(special, bool)
        self.longest = max((len(ws) for ws in (*self.questions, *self.passages)), default=0)


def _heads(text: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each position's first ANCHOR codes, in the order of the codes; ranks of ever longer heads, so that nothing overflows."""
    both = np.concatenate((text, np.zeros(ANCHOR, np.int64), test, np.zeros(ANCHOR, np.int64)))
    rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
    head, base = rank, int(rank.max(initial=0)) + 1
    for j in range(1, ANCHOR):
        head = np.unique(head * base + np.concatenate((rank[j:], np.zeros(j, np.int64))), return_inverse=True)[1].astype(np.int64)
    return head[: len(text)], head[len(text) + ANCHOR : len(text) + ANCHOR + len(test)]


class Match:
    """What verbatim matches show of an item in a text: distinctive test positions, their places in the text, and the longest match with its place."""

    __slots__ = ("positions", "places", "length", "at")

    def __init__(self) -> None:
        self.positions: set[int] = set()
        self.places: set[int] = set()
        self.length, self.at = 0, 0


def anchors(docs: list[list[str]], items: Items) -> dict[tuple[int, int], Match]:
    """(document, item) -> verbatim matches of at least ANCHOR words that hold a distinctive word."""
    found: dict[tuple[int, int], Match] = {}
    code = items.code
    sizes = np.array([len(ws) + 1 for ws in docs], np.int64)
    # words of no test are one code (1 ends a test, so it is never matched), 0 ends a document
    text = np.fromiter((c for ws in docs for c in (*(code.get(w, 1) for w in ws), 0)), np.int64, int(sizes.sum()))
    test = items.test
    if len(text) < ANCHOR or len(test) < ANCHOR:
        return found
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    own = np.repeat(np.arange(len(docs)), sizes)
    array = suffix_array(text, items.longest)
    heads, wanted = _heads(text, test)
    keys = heads[array]  # rises along the suffix array
    inside = np.convolve(test > 1, np.ones(ANCHOR, int))[ANCHOR - 1 :][: len(test)] == ANCHOR
    inside[max(0, len(test) - ANCHOR + 1) :] = False
    at = np.nonzero(inside)[0]
    lo, hi = np.searchsorted(keys, wanted[at], "left"), np.searchsorted(keys, wanted[at], "right")
    at, lo, size = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ahead = np.concatenate(([0], np.cumsum(items.special)))
    test_end, text_end = np.append(test, 1), np.append(text, 0)
    whole = np.concatenate(([0], np.cumsum(size)))
    for begin in range(0, int(whole[-1]), SLICE):
        n = np.arange(begin, min(begin + SLICE, int(whole[-1])))
        which = np.searchsorted(whole, n, "right") - 1
        t, p = at[which], array[lo[which] + n - whole[which]]
        # matches that the words before would extend are parts of others
        part = (t > 0) & (p > 0) & (test[t - 1] == text[p - 1]) & (test[t - 1] > 1)
        t, p = t[~part], p[~part]
        length, alive = np.full(len(t), ANCHOR), np.arange(len(t))
        while len(alive):
            i, j = np.minimum(t[alive] + length[alive], len(test)), np.minimum(p[alive] + length[alive], len(text))
            alive = alive[(test_end[i] == text_end[j]) & (test_end[i] > 1)]
            length[alive] += 1
        hit = ahead[t + length] > ahead[t]
        for i, j, m in zip(t[hit].tolist(), p[hit].tolist(), length[hit].tolist(), strict=True):
            d = int(own[j])
            match = found.setdefault((d, int(items.owner[i])), Match())
            marked = np.nonzero(items.special[i : i + m])[0].tolist()
            match.positions.update(i + x for x in marked)
            match.places.update(j - int(starts[d]) + x for x in marked)
            if m > match.length:
                match.length, match.at = m, j - int(starts[d])
    return found


def align(a: list[str], b: list[str]) -> list[bool]:
    """Which words of a agree with words of b in order (longest common subsequence), misspelt ones between aligned neighbours included."""
    if not a or not b:
        return [False] * len(a)
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(1, len(a) + 1):
        diagonal = table[i - 1, :-1] + (y == x[i - 1])
        table[i, 1:] = np.maximum.accumulate(np.maximum(diagonal, table[i - 1, 1:]))
    flags, place = [False] * len(a), [-1] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            flags[i], place[i] = True, j
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    last = -1
    for i in range(len(a)):
        if flags[i]:
            last = place[i]
            continue
        following = next((place[k] for k in range(i + 1, min(i + 6, len(a))) if flags[k]), min(len(b), last + 5) if last >= 0 else -1)
        gap = range(max(last + 1, following - 6), following) if following > 0 else range(0)
        for j in gap:
            joined = b[j] + b[j + 1] if j + 1 < following else ""
            if _near(a[i], b[j]) or a[i] == joined or (i + 1 < len(a) and a[i] + a[i + 1] == b[j]):
                flags[i] = True
                break
    return flags


def _agrees(ws: list[str], flags: list[bool], special: set[str], least: float, least_special: float) -> bool:
    if not ws or sum(flags) < least * len(ws):
        return False
    own = [f for w, f in zip(ws, flags, strict=True) if w in special]
    return len(own) >= 2 and sum(own) >= least_special * len(own)


def _windows(context: list[str], places: Iterable[int], reach: int) -> list[list[str]]:
    """The stretches of a context within `reach` words of some place; the whole context if there is no place."""
    out: list[list[int]] = []
    for p in sorted(places):
        if out and p - reach <= out[-1][1]:
            out[-1][1] = p + reach + 1
        else:
            out.append([max(0, p - reach), p + reach + 1])
    return [context[a:b] for a, b in out] or [context]


def leaked(question: list[str], context: list[str], items: Items, k: int, places: Iterable[int] = (), run: int = 20) -> str | None:
    """How item k stands in a record: "question", "question in context", "sentence", "run", or None.

    `places` are positions of verbatim matches in the context: the question, the sentences and the runs are looked for around them, each by itself.
    """
    special = items.distinct[k]
    asked = items.questions[k]
    near, far = set(question), set(context)
    share = lambda ws, held: sum(w in held for w in ws) / max(1, len(ws))
    of_asked, of_passage = [w for w in asked if w in special], [[w for w in s if w in special] for s in items.sentences[k]]
    # light edits leave at least half of the words of a question, sentence or run as they are, and four of ten distinctive ones
    likely = lambda ws, own, held: share(own, held) >= 0.4 and share(ws, held) >= 0.5
    if max([share(of_asked, near), share(of_asked, far), *(share(s, far) for s in of_passage)]) < 0.4 and share([w for s in of_passage for w in s], far) < 0.2:
        return None
    if asked and likely(asked, of_asked, near):
        flags = align(asked, question)
        if _agrees(asked, flags, special, 0.7, 0.75) and len(question) <= 1.6 * len(asked) + 4:
            return "question"
        if _agrees(asked, flags, special, 0.8, 0.75):
            return "question in context"
    if not context:
        return None
    passage = items.passages[k]
    around = _windows(context, places, max(len(asked), len(passage)) + len(passage) // 2)
    for part in around:
        held = set(part)
        if asked and likely(asked, of_asked, held) and _agrees(asked, align(asked, part), special, 0.8, 0.75) and _close(asked, part):
            return "question in context"
        for s, own in zip(items.sentences[k], of_passage, strict=True):
            if len(s) >= 5 and likely(s, own, held) and _agrees(s, align(s, part), special, 0.75, 0.75) and _close(s, part):
                return "sentence"
        if not _run_likely(passage, special, held, run):
            continue
        flags = align(passage, part)
        for i in range(len(passage) - run + 1):
            if sum(flags[i : i + run]) >= 0.85 * run and _agrees(passage[i : i + run], flags[i : i + run], special, 0.85, 0.8) and _close(passage[i : i + run], part):
                return "run"
    return None


def _run_likely(passage: list[str], special: set[str], held: set[str], run: int) -> bool:
    """False only if every run of words has less than six of ten of its words, or four of ten distinctive ones, as they are in the context: more than light edits, as 17 of 20 must agree."""
    upto, own, all_own = [0], [0], [0]
    for w in passage:
        known, marked = w in held, w in special
        upto.append(upto[-1] + known)
        own.append(own[-1] + (known and marked))
        all_own.append(all_own[-1] + marked)
    return any(upto[i + run] - upto[i] >= 0.6 * run and own[i + run] - own[i] >= max(1, 0.4 * (all_own[i + run] - all_own[i])) for i in range(len(passage) - run + 1))


def _close(ws: list[str], context: list[str]) -> bool:
    """Whether the words stand close together in the context: some window little longer than they are holds most of them."""
    wanted, width = Counter(ws), len(ws) + max(4, len(ws) // 3)
    have: Counter = Counter()
    good, best = 0, 0
    for j, w in enumerate(context):
        if w in wanted:
            have[w] += 1
            good += have[w] <= wanted[w]
        if j >= width and (old := context[j - width]) in wanted:
            good -= have[old] <= wanted[old]
            have[old] -= 1
        best = max(best, good)
    return best >= 0.6 * len(ws)


def _common_words(rows: DataFrame) -> frozenset[str]:
    """Words of more than a twentieth of all test items: at most 20 x the words of an item, whatever the number of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ws": [sorted({*words(q), *words(p)}) for q, p in zip(b["q"], b["p"], strict=True)]}, dtype=object)

    most = common_share(rows.count())
    counted = rows.select("q", "p").mapInPandas(run, "ws array<string>").select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r["w"] for r in counted.where(F.col("n") > most).select("w").collect())


def find_leaks(records: DataFrame, tests: DataFrame, key: str = "qa_id", question: str = "question", context: str = "context", item: str = "item_id", item_question: str = "question", item_passage: str = "passage", block: int = 2000, evidence: int = 2) -> DataFrame:
    """Distinct (key, item bigint, how string, verbatim int, longest int, place int, in_question boolean): each item that stands in each record.

    verbatim: its distinctive words in verbatim matches; longest, place: words of the longest verbatim match and the word of the question
    or the context at which it begins.  Null, empty and blank texts on either side match nothing; the other text of the same row still
    counts. Texts of any length are searched whole. Empty tables give no row; other columns play no part; repeated records each get their
    rows. The result is the same for every `block`.
    """
    rows = tests.select(F.col(item).cast("bigint").alias("i"), F.col(item_question).alias("q"), F.col(item_passage).alias("p")).where("i is not null")
    held = records.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(context).alias("c"))
    columns = {"key": held.schema["key"].dataType.simpleString(), "item": "bigint", "how": "string", "verbatim": "int", "longest": "int", "place": "int", "in_question": "boolean"}
    common = _common_words(rows)
    blocks = max(1, -(-rows.count() // block))
    spark = records.sparkSession
    shared = []
    for b in range(blocks):
        here = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        shared.append(spark.sparkContext.broadcast([tuple(r) for r in here.orderBy("i", "q", "p").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = Items(shared[0].value, common) if blocks == 1 else None

        def search(keys: list, docs: list[list[str]]) -> pd.DataFrame:
            out = []
            for b in shared:
                items = only or Items(b.value, common)
                pairs: dict[tuple[int, int], list[Match | None]] = {}
                for (d, k), m in anchors(docs, items).items():
                    pairs.setdefault((d // 2, k), [None, None])[d % 2] = m
                for (d, k), (asked, told) in pairs.items():
                    verbatim = len({x for m in (asked, told) if m for x in m.positions})
                    if verbatim >= evidence and (how := leaked(docs[2 * d], docs[2 * d + 1], items, k, told.places if told else ())):
                        best = max((m for m in (asked, told) if m), key=lambda m: m.length)
                        out.append((keys[d], items.ids[k], how, verbatim, best.length, best.at, best is asked))
                if blocks > 1:
                    b.__dict__.pop("_value", None)  # a worker holds one block at a time
            return pd.DataFrame(out, columns=list(columns)).astype({"key": object, "how": object})

        keys: list = []
        docs: list[list[str]] = []
        size = 0
        for batch in batches:
            for x, q, c in batch.itertuples(index=False):
                keys.append(x)
                docs += [words(q), words(c)]
                size += len(docs[-2]) + len(docs[-1])
                if size >= SHARD:
                    yield search(keys, docs)
                    keys, docs, size = [], [], 0
        if keys:
            yield search(keys, docs)

    out = held.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in columns.items()))
    return out.distinct().withColumnRenamed("key", key).withColumnRenamed("item", item)
