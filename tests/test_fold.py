from ledgerloom.functions.fold import fold, tokens, unmark


def test_fold():
    assert fold(None) == fold("") == ""
    assert fold("Café re​sult Vеrmіn &amp; <b>x</b>") == "cafe result vermin &  x "
    assert fold("baissÃ©") == "baisse"
    assert unmark("const-\nrained a - b") == "constrained a - b"


def test_tokens():
    assert tokens("$76,616,465 and 31.5% of 1 234") == ["76616465", "and", "31.5", "of", "1234"]
    assert len(tokens("w " * 300_000)) == 300_000
