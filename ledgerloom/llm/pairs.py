"""Defects of prompt and response pairs.

Method: a suffix automaton of the prompt measures how much of the response is copied from it; a refusal
automaton (`automata.Machine`) reads the folded response once; a stack of delimiters and the passage behind the pair tell a
response that breaks off; stop words vote on the languages of both sides.  A pair has the first defect of
`DEFECTS` that holds.  All is one narrow pass over the rows, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fold import fold, unmark
from ledgerloom.llm.automata import Machine

DEFECTS = ("empty_answer", "copies_question", "refusal", "other_language", "truncated_answer")

# Answers that stand for none.
PLACEHOLDERS = frozenset(
    ["n/a", "na", "nan", "null", "nil", "none", "tbd", "tba", "todo", "empty", "blank", "unknown", "undefined", "missing", "void", "pending", "placeholder", "xxx", "no answer", "no answer given", "not available", "not applicable", "to be determined", "to be done", "no response", "answer", "keine angabe", "k.a", "sans objet", "s/o", "sin respuesta", "lorem ipsum"]
)

# Classes of words in refusals, on folded text.
REFUSAL_CLASSES = {
    "cannot": "cannot can't won't don't couldn't didn't".split(),
    "unable": "unable incapable".split(),
    "do": "answer help assist provide discuss comment respond reply judge say tell find determine share offer speculate give comply fulfil know see advise locate identify confirm disclose decline".split(),
    "text": "passage text excerpt material context document filing source question record".split(),
    "tell": "say state contain provide mention specify give include disclose tell answer cover address reveal hold".split(),
    "told": "stated given disclosed mentioned specified found provided available answerable contained said known".split(),
    "seen": "answered determined established derived inferred said given found provided".split(),
    "lack": "sufficient enough adequate".split(),
    "facts": "detail details information context data evidence".split(),
    "dedo": "beantworten helfen sagen angeben antworten geben nennen aussern".split(),
    "esdo": "responder ayudar contestar decir informacion dar opinar".split(),
}
# How answers refuse.
REFUSALS = (
    "i'm|i|we am? <cannot>|decline|refuse to? ~2 <do> ; i'm|i am? can|could|will|would|do not|rather_not|prefer_not to? ~2 <do> ; i'm|i am|was? not? <unable>|able to ~2 <do> ; i must|have_to|need_to decline|refuse|pass ; i'd|i would? rather_not",
    "i have|had no|not ~2 <facts> ; i don't|do_not|didn't|did_not know|have ; i'm|i am? sorry|afraid ~~12 can't|cannot|unable|not|no|don't ; sorry|apologies|unfortunately|regrettably ~~10 no_answer|cannot|can't|could_not|unable|not_able|not_possible|no_information|not_available",
    "as a|an ai|assistant|language_model|language_tool|artificial|chatbot|model|virtual ; no answer|reply|response|statement can|could|is|may be? given|made|possible|available|offered|provided ; would|might be|not_be inappropriate|appropriate|improper|irresponsible|wrong for_me? to",
    "no further? information|detail|details|data ~~9 is|are|was|were available|given|provided|found ; that's|that_is|this_is|it's|it_is outside|beyond|not_something ~~6 i|my|me",
    "<text> ~~12 does_not|doesn't|do_not|don't|did_not|didn't|fails_to ~2 <tell> ; isn't|is_not|wasn't|not|no <lack> <facts> ; insufficient|inadequate <facts> ; can't|cannot|can_not|could_not|couldn't be <seen> ; not <told> in|from|by|on the|this|that|any <text> ; nothing_in the|this ~2 <text>",
    "reply|answer|response is|was not_possible ; please consult|see|check|contact|ask|refer_to ~~14 unable|cannot|can't|could_not|not ; unable|not_able|not_permitted|not_allowed|not_in_a_position to ~1 <do> ; we regret|are_sorry|cannot|can't|are_unable|decline ~~9 reply|answer|respond|help|comment|possible|provide|assist",
    "kann|konnte|darf|mochte|werde ich|wir? ~6 nicht|keine ~~7 <dedo> ; ich kann|darf|mochte|konnte|weiss ~~10 nicht|keine ; geht|lasst_sich|ist ~4 nicht|keine ~~5 hervor|beantworten|angegeben|moglich|enthalten ; tut_mir_leid ; es_tut_mir ; bedaure",
    "je ne? peux|puis|suis|sais|dispose|souhaite ~~4 pas|incapable ; desole|navre|regrette ~~10 pas|impossible ; impossible_de repondre|dire|determiner ; le|ce texte|passage|document|extrait ne ~3 pas",
    "no puedo|podemos|me_es_posible|se|dispongo|tengo|estoy_en_condiciones ~~9 <esdo> ; lo_siento ; lamento ; disculpe ; el texto|pasaje|documento|fragmento no ~3 dice|indica|contiene|menciona",
)
_REFUSING = Machine([("refusal", 1.0, p.strip()) for group in REFUSALS for p in group.split(" ; ")], REFUSAL_CLASSES)
_REFUSAL_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z]+)?|[.,;:!?]")


def refuses(text: str) -> bool:
    """Whether the refusal automaton reads a refusal in a folded text."""
    return "refusal" in _REFUSING.run(_REFUSAL_TOKEN.findall(text.replace("’", "'")))


# Words that only one of the languages uses often.
STOPWORDS = {
    "en": frozenset("the and of to was were is are that which with for its from by has have had this these what who how did does not or could be been as at an it because must under our their into than other will would about when where why whom".split()),
    "de": frozenset("der die das und den dem des ein eine einen einem einer ist sind war waren wurde wurden nicht mit von zu fur auf im am bei weil warum wie welche welcher hat haben auch nach aus uber sich als vergeben neue stieg um jahr ihre seine".split()),
    "fr": frozenset("le la les des du et un une est sont etait ete dans pour par sur au aux avec que qui ont pourquoi quel quelle parce pas plus ce cette ses leur elles ils augmente nouvelles passe ventes".split()),
    "es": frozenset("el los las del y una un es son fue por para con que en se su sus porque como cual cuales lo al mas pero hizo nuevos aumentaron pedidos ventas entre sobre este esta".split()),
    "it": frozenset("il gli della delle dei nel nella che di per con sono stato perche come quale anche piu non una uno del".split()),
    "pt": frozenset("os dos das da do uma um nao com para por que sao foi como mais na no ao pela pelo".split()),
    "nl": frozenset("het een van en zijn niet met voor op aan door werd dat deze wat hoe waarom bij ook naar uit".split()),
}
# Words after which no sentence ends.
OPEN_ENDS = frozenset(
    "a an the of to in on at by for with from into onto and or but because although though while which that who whom whose if as than is are was were be been has have had will would could should may might must can its their our his her this these those under over between among against through during despite owing due says said not no mainly other another set held earned bought sells deliver lower gain put wanted access about within without per"
    " der die das den dem des ein eine einen einem einer und oder aber weil mit von zu fur auf im am bei durch nach aus uber als dass neue"
    " le la les des du de et ou un une dans pour par sur au aux avec que qui parce a ont"
    " el los las del y o una con en por para que se su sus al porque hizo nuevos lo".split()
)
# Verbs before which a noun phrase is whole, so that it can be a short answer.
SUBJECT_DONE = frozenset("could can may might will would should must is are was were has have had does did says say reports".split())
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TERMINAL = re.compile(r"[.!?。！？](?:[\"'”’»)\]]|\s*\[[^\]]*\])*\s*$")
_PREFACE = re.compile(r"^\W*(?:you asked|you ask|question|prompt|q|frage|vous demandez|pregunta|the question (?:is|was)|your question(?: (?:is|was))?|regarding the question|asked)\s*[:\-–]\s*", re.I)
_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}


def _words(folded: str) -> list[str]:
    """Words and numbers of a folded text, numbers without separators of thousands."""
    return [w.replace(",", "") if w[0].isdigit() else w for w in _WORD.findall(folded)]


class SuffixAutomaton:
    """Automaton of all factors of a token list."""

    def __init__(self, tokens: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def matches(self, tokens: list[str]) -> list[int]:
        """For each position, the length of the longest factor that ends there."""
        state, size, out = 0, 0, []
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if t in self.next[state]:
                state, size = self.next[state][t], size + 1
            else:
                state, size = 0, 0
            out.append(size)
        return out


def copied(prompt: list[str], response: list[str], least: int = 2) -> float:
    """Share of the response's tokens inside factors of the prompt of at least `least` tokens."""
    if not response:
        return 0.0
    covered, upto = 0, len(response)
    for end, size in reversed(list(enumerate(SuffixAutomaton(prompt).matches(response), 1))):
        if size >= min(least, len(response)) and end - size < upto:
            covered += min(end, upto) - (end - size)
            upto = end - size
    return covered / len(response)


def language(words: list[str]) -> str | None:
    """Language by votes of stop words; None if they are too few or even."""
    votes = sorted(((sum(w in own for w in words), lang) for lang, own in STOPWORDS.items()), reverse=True)
    (most, lang), (second, _) = votes[0], votes[1]
    return lang if most >= 2 and most > 1.25 * second else None


def _balanced(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if c in "([{«“":
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return not stack


def _near(a: str, b: str) -> bool:
    """Whether two words differ by at most one edit (two in words of 8 letters and more)."""
    if a == b:
        return True
    most = 2 if min(len(a), len(b)) >= 8 else 1
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > most:
        return False
    # of most + 1 parts of a word, most edits leave one as it is
    h = len(a) // (most + 1)
    if most == 1 and a[:h] != b[:h] and a[h:] != b[h - len(a) :]:
        return False
    if most == 2 and a[:h] not in b and a[h : 2 * h] not in b and a[2 * h :] not in b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= most


def truncated(question: str, answer: str, context: str) -> bool:
    """Whether an answer without final punctuation breaks off inside a word or a sentence."""
    text = answer.strip()
    if re.search(r"(?:\.\.\.|…)\W*$", text):
        return True
    if _TERMINAL.search(text):
        return False
    if not _balanced(text) or re.search(r"[,;:($€£&+/\-–—]$", text):
        return True
    words = _words(fold(text))
    if not words:
        return False
    last = words[-1]
    if len(words) >= 3 and last in OPEN_ENDS and not last.isdigit():
        return True
    source = _words(fold(context)) + _words(fold(question))
    if len(words) >= 3 and source and last not in source:
        longer = {w for w in source if len(w) > len(last) and w.startswith(last)}
        before = words[-2]
        if any(source[k] in longer and source[k - 1] == before for k in range(1, len(source))):
            return True
        if longer and len(words) >= 6 and len(last) >= 3 and not last[0].isdigit() and not any(last in own for own in STOPWORDS.values()):
            return True
        if last in ("mill", "milli", "millio", "bill", "billi", "billio", "dol", "doll", "dolla", "perc", "percen", "perce", "mil", "bil", "millio") or len(last) == 1 and last.isalpha() and len(words) >= 6:
            return True
    return len(words) >= 6 and _breaks_off(words, context)


def _breaks_off(words: list[str], context: str) -> bool:
    """Whether the answer retells a sentence of the passage from its start and stops before its end."""
    for sentence in re.split(r"(?<=[.!?])\s+", unmark(context)):
        own = _words(fold(sentence))
        if len(own) < 6 or sum(w in own for w in words) < 0.7 * len(words):
            continue
        heads = set(own[:6])
        if sum(w in heads for w in words[:5]) < 2:
            continue
        for k in range(len(own) - 2, -1, -1):
            if own[k : k + 2] == words[-2:]:
                rest = own[k + 2 :]
                if rest and rest[0] in SUBJECT_DONE:
                    return False
                return len(rest) > 0 and (rest[0] in ("million", "billion", "percent", "dollars") or (rest[0] in OPEN_ENDS and rest[0] in ("in", "to", "at", "from", "of", "for") and len(rest) <= 3) or len(rest) > 3 and rest[0] not in ("and", "owing", "or", "which"))
    return False


def defect(question: str | None, answer: str | None, context: str | None = None) -> str | None:
    """The first of DEFECTS that holds for a pair, else None."""
    plain = unmark(answer).strip()
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", plain.lower())
    if not bare or bare in PLACEHOLDERS:
        return "empty_answer"
    folded = fold(_PREFACE.sub("", plain)).replace("’", "'")
    words, asked = _words(folded), _words(fold(question))
    if len(asked) >= 3 and len(words) >= 0.7 * len(asked):
        share = copied(asked, words)
        known = set(asked)
        fresh = [w for w in words if w not in known]
        # more new words than half never make a copy
        spoilt = sum(any(_near(w, a) for a in known) for w in fresh) if len(fresh) <= len(words) // 2 and share > 0.3 else 0
        if (share + spoilt / len(words)) >= 0.8 and (copied(words, asked) >= 0.7 or len(fresh) == spoilt) and len(fresh) - spoilt <= max(1, len(words) // 8) and not any(w[0].isdigit() for w in fresh):
            return "copies_question"
    if refuses(fold(plain)):
        own = {w for w in words if len(w) > 3 or w[0].isdigit()}
        passage = set(_words(fold(context)))
        digits = [w for w in own if w[0].isdigit()]
        if not (digits and all(w in passage for w in digits) and len(own & passage) > 0.6 * len(own)):
            return "refusal"
    a, q = language(words), language(asked)
    if a and q and a != q:
        return "other_language"
    if truncated(question or "", plain, context or ""):
        return "truncated_answer"
    return None


def find_defects(df: DataFrame, key: str, question: str, answer: str, context: str | None = None) -> DataFrame:
    """Distinct (key, defect string) of the broken pairs.

    A null, blank or placeholder answer is empty_answer whatever the question; a null question can be copied by
    nothing and has no language, so only the answer's own defects remain; null contexts only make truncation
    harder to see.  Texts of any length are read whole.  An empty table gives no row; other columns play no part.
    """
    schema = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a"), (F.col(context) if context else F.lit(None)).cast("string").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, kind) for k, q, a, c in b.itertuples(index=False) if (kind := defect(q, a, c))]
            yield pd.DataFrame(out, columns=["key", "defect"])

    return rows.mapInPandas(run, f"key {schema}, defect string").distinct().withColumnRenamed("key", key)
