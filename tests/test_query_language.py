import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.plans import query as Q
from mnemora.rules import Rules

REWRITES = [
    ("golang template -url:*stackoverflow*", "+golang +template -url:*stackoverflow*"),
    ('"free software" url:*wikipedia.org*', '+"free software" +url:*wikipedia.org*'),
    ('"a b c" d', '+"a b c" +d'),
    ('a "b" c', '+a +"b" +c'),
    ('-"free" golang', '-"free" +golang'),
    ('-"free software" golang', '-"free +software" golang'),
    ('+"free software" golang', '+"free +software" golang'),
    ('url:"a b" c', '+url:"a b" +c'),
    ('say "unclosed phrase here', '+say +"unclosed phrase here'),
    ('5" disk "x y"', '+5" disk "x +y"'),
    ("(go|golang) x", "+(go|golang) +x"),
    ("-", "-"),
    ("", ""),
    ("   ", ""),
]


@pytest.mark.parametrize("text,expected", REWRITES)
def test_rewrite(text, expected):
    assert Q.require_all(text) == expected


ALIASES = Rules(aliases={"go": "(go|golang)", "!so": "url:*stackoverflow.com*", "a": "b", "b": "c"})


@pytest.mark.parametrize("text,expected", [("go  web !so", "(go|golang) web url:*stackoverflow.com*"), ("  web  x ", "  web  x "), ("a b", "b c"), ('"go web"', '"go web"'), ('"x go y"', '"x (go|golang) y"'), ("-go", "-go"), ("Go", "Go")])
def test_aliases(text, expected):
    assert ALIASES.resolve(text) == expected


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="xyz \t", max_size=20))
def test_aliases_without_hit_change_nothing(text):
    assert ALIASES.resolve(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab"+-*?:~^/\\ 1', max_size=25))
def test_any_query_parses(text):
    for c in Q.parse(Q.require_all(text)):
        assert c.kind in Q.KINDS and c.occur in (Q.MUST, Q.SHOULD, Q.MUST_NOT)


def test_clauses():
    c = {(x.occur, x.kind, x.field, x.value) for x in Q.parse('+title:"Big Bang" -url:*x* foo~2 /re+/ bar^3 score:>2 the')}
    assert c == {("must", "phrase", "title", "Big Bang"), ("must_not", "wildcard", "url", "*x*"), ("should", "fuzzy", None, "foo"), ("should", "regex", None, "re+"), ("should", "term", None, "bar"), ("should", "range", "score", "2")}
    assert [x.boost for x in Q.parse("bar^3")] == [3.0]
    assert Q.parse(r"a\*b")[0].kind == "term"
    assert Q.wildcard_regex("a*b?c.") == r"^a.*b.c\.$"
