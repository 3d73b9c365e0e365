"""Weighted finite-state transducers over words, made of patterns, and composed by running them in one pass.

Two machines are composed.  The lexical transducer reads a word and writes the symbols it stands for: itself, the
classes it belongs to, the beginnings it has.  The pattern transducer reads symbols and writes (kind, weight) where a
pattern ends.  The composition is made deterministic as it is used: a state is the set of places in all patterns
reached so far, kept by number, and a step is one look-up by state and symbols.

A pattern is items between spaces.  An item is alternatives between bars, `<name>` for a class (without `_`), `stem+` for words
that begin so, `_` between words of a phrase, with `?` for optional or `*` for any number behind; `~n` is a gap of
at most n words, `~~n` of at most n words and marks; `^` and `$` are the ends of the text.  Matches may begin anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

ANY, WORD = "\0any", "\0word"
#: Marks that patterns read over, unless they name them.
SKIPPED = frozenset('"')
#: States and steps kept; beyond it both tables are emptied and grow again, so memory is bounded and results are the same.
KEPT = 200_000


class Machine:
    """The composition of a lexical transducer (classes) with a pattern transducer (kind, weight, pattern)."""

    def __init__(self, patterns: Iterable[tuple[str, float, str]], classes: Mapping[str, Iterable[str]] | None = None) -> None:
        self.arcs: list[dict[str, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.ends: dict[int, tuple[str, float]] = {}
        self.stems: set[str] = set()
        literals: set[str] = set()
        for kind, weight, pattern in patterns:
            at = 0
            for item in pattern.split():
                at = self._item(at, item, literals)
            self.ends[at] = max(self.ends.get(at, (kind, 0.0)), (kind, weight), key=lambda x: x[1])
        self.of_word: dict[str, set[str]] = {w: {w} for w in literals}
        for name, words in (classes or {}).items():
            for w in words:
                self.of_word.setdefault(w, set()).add(f"<{name}>")
        self._reset()
        self._symbols: dict[str, int] = {}

    def _new(self) -> int:
        self.arcs.append({})
        self.free.append(set())
        return len(self.arcs) - 1

    def _item(self, at: int, item: str, literals: set[str]) -> int:
        if m := re.fullmatch(r"(~~?)(\d+)", item):
            end = self._new()
            self.free[at].add(end)
            for _ in range(int(m[2])):
                step = self._new()
                self.arcs[at].setdefault(ANY if m[1] == "~~" else WORD, set()).add(step)
                self.free[step].add(end)
                at = step
            return end
        suffix = item[-1] if item[-1] in "?*" and len(item) > 1 else ""
        begin, end = self._new(), self._new()
        self.free[at].add(begin)
        for phrase in item.removesuffix(suffix).split("|"):
            here = begin
            for symbol in phrase.split("_"):
                if symbol.endswith("+"):
                    self.stems.add(symbol[:-1])
                elif not symbol.startswith("<"):
                    literals.add(symbol)
                step = self._new()
                self.arcs[here].setdefault(symbol, set()).add(step)
                here = step
            self.free[here].add(end)
        if suffix:
            self.free[begin].add(end)
        if suffix == "*":
            self.free[end].add(begin)
        return end

    def _closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def _reset(self) -> None:
        self._start = self._closed({0})
        self._sets = [self._start]
        self._numbers = {self._start: 0}
        self._written: list[tuple[tuple[str, float], ...]] = [self._outputs(self._start)]
        self._steps: dict[tuple[int, str], int] = {}

    def _outputs(self, states: frozenset[int]) -> tuple[tuple[str, float], ...]:
        best: dict[str, float] = {}
        for s in states:
            if s in self.ends:
                kind, weight = self.ends[s]
                best[kind] = max(weight, best.get(kind, 0.0))
        return tuple(sorted(best.items()))

    def symbols(self, token: str) -> frozenset[str]:
        """What the lexical transducer writes for a word or mark."""
        own = set(self.of_word.get(token, ()))
        own.update(f"{token[:n]}+" for n in range(2, len(token) + 1) if token[:n] in self.stems)
        own.add(ANY)
        if token[0].isalnum() or token[0] == "@":
            own.add(WORD)
        return frozenset(own)

    def _step(self, state: int, token: str) -> int:
        here = self._sets[state]
        symbols = self.symbols(token)
        to = {t for s in here for x in symbols & self.arcs[s].keys() for t in self.arcs[s][x]}
        if token in SKIPPED:
            to |= here
        after = self._closed(to | {0})
        number = self._numbers.get(after)
        if number is None:
            number = self._numbers[after] = len(self._sets)
            self._sets.append(after)
            self._written.append(self._outputs(after))
        self._steps[state, self._kind(token)] = number
        return number

    def _kind(self, token: str) -> str:
        """Words that write the same symbols take the same step; those that write none of their own are one."""
        return token if token in self.of_word or token in SKIPPED or any(token.startswith(s) for s in self.stems) else "w" if token[0].isalnum() or token[0] == "@" else "m"

    def run(self, tokens: Iterable[str]) -> dict[str, float]:
        """The greatest weight of each kind that some match in the tokens gives."""
        found: dict[str, float] = {}
        state, kinds = 0, self._symbols
        if len(self._steps) > KEPT or len(kinds) > KEPT:
            self._reset()
            kinds.clear()
        for t in ("^", *tokens, "$"):
            k = kinds.get(t)
            if k is None:
                k = kinds[t] = self._kind(t)
            after = self._steps.get((state, k))
            state = self._step(state, t) if after is None else after
            for kind, weight in self._written[state]:
                if weight > found.get(kind, 0.0):
                    found[kind] = weight
        return found
