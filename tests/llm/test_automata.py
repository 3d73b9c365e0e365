import random

from ledgerloom.llm import automata

CLASSES = {"x": ["a", "b"]}


def ends(items, tokens, at):
    """All places where a match of the items from `at` can end, by trying everything."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if item[0] == "~":
        n, out = int(item.lstrip("~")), set()
        for m in range(n + 1):
            gap = tokens[at : at + m]
            if len(gap) == m and (item.startswith("~~") or all(t[0].isalnum() for t in gap)):
                out |= ends(rest, tokens, at + m)
        return out
    suffix = item[-1] if item[-1] in "?*" else ""
    out = ends(rest, tokens, at) if suffix else set()
    for alternative in item.removesuffix(suffix).split("|"):
        here = at
        for s in alternative.split("_"):
            if here < len(tokens) and (tokens[here] == s or s == "<x>" and tokens[here] in CLASSES["x"] or s.endswith("+") and tokens[here].startswith(s[:-1])):
                here += 1
            else:
                here = None
                break
        if here is not None:
            out |= ends(items[0:1] + rest if suffix == "*" else rest, tokens, here)
    return out


def test_against_trying_everything():
    r = random.Random(3)
    pieces = ["a", "b|c", "<x>", "a_b", "c?", "b|a*", "~1", "~~2", "ab+", "^", "$", ","]
    for _ in range(1500):
        patterns = [(f"k{n}", r.choice([0.5, 0.9]), " ".join(r.choice(pieces) for _ in range(r.randint(1, 4)))) for n in range(r.randint(1, 3))]
        machine = automata.Machine(patterns, CLASSES)
        for _ in range(4):
            tokens = [r.choice(["a", "b", "c", "abc", ","]) for _ in range(r.randint(0, 6))]
            whole = ["^", *tokens, "$"]
            # a pattern that needs no token matches as soon as any token is read
            want = {k: w for k, w, p in patterns if any(e for at in range(len(whole)) for e in ends(p.split(), whole, at))}
            assert machine.run(tokens) == want, (patterns, tokens)


def test_tables_are_emptied_without_changing_results(monkeypatch):
    machine = automata.Machine([("k", 1.0, "a ~2 b")])
    monkeypatch.setattr(automata, "KEPT", 3)
    assert [bool(machine.run(t.split())) for t in ("a x b", "x y z", "a b", "b a", "a q r b", "a x y z b")] == [True, False, True, False, True, False]


def test_skipped_marks_and_named_ones():
    machine = automata.Machine([("k", 1.0, "a b"), ("q", 1.0, 'a ~1 "')])
    assert machine.run(["a", '"', "b"]) == {"k": 1.0, "q": 1.0}
