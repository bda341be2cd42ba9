import pytest

from textmatch.fql import And, InField, InLanguage, Not, Or, Phrase, QuerySyntaxError, Scored, Term, Typed, lex, parse, unwrap


def test_unwrap():
    assert unwrap(" fql(a AND b) ") == "a AND b" and unwrap("FQL(a)") is None and unwrap("a") is None


def test_precedence():
    assert parse("a OR b AND NOT c") == Or(Term("a"), And(Term("b"), Not(Term("c"))))
    assert parse("(a or b) and c") == And(Or(Term("a"), Term("b")), Term("c"))
    assert parse("a NOT b") == And(Term("a"), Not(Term("b")))


def test_filters():
    assert parse('EXACT:"iPhone 15" OR samsung') == Or(Typed("exact", "iPhone 15"), Term("samsung"))
    assert parse("müller SCORE>0.8") == Scored(Term("müller"), ">", 0.8)
    assert parse("(a OR b) SCORE>=0.5") == Scored(Or(Term("a"), Term("b")), ">=", 0.5)
    assert parse("LANG:german name:x") == InLanguage("german", InField("name", Term("x")))
    assert parse('"new york"') == Phrase("new york")


@pytest.mark.parametrize("bad", ["", "a AND", "(a", "a SCORE>2", "a SCORE b", "'open", "EXACT:", "a)"])
def test_errors(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_unknown_characters_are_skipped():
    assert [v for _, v, _ in lex("a & b")] == ["a", "b", ""]
