"""The query language: rewriting, parsing and the clauses it yields. Plain Python on one string."""

from __future__ import annotations

import re
from dataclasses import dataclass

from mnemora.functions import text as X

MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
KINDS = ("term", "phrase", "wildcard", "regex", "fuzzy", "range")
_RANGE = re.compile(r"(>=|<=|>|<)\"?(-?\d+(?:\.\d+)?)\"?$")


def require_all(text: str) -> str:
    """Gives every unsigned word outside quotation marks a +. A word with an odd number of quotation marks turns
    quoting on or off, unless it is signed and stands outside, in which case it is passed over."""
    out, quoted = [], False
    for word in text.split():
        if not quoted and word[0] in "+-":
            out.append(word)
            continue
        out.append(word if quoted else "+" + word)
        quoted ^= word.count('"') % 2 == 1
    return " ".join(out)


@dataclass(frozen=True)
class Clause:
    occur: str
    kind: str
    field: str | None  # None: any field
    value: str
    terms: tuple[str, ...] = ()
    offsets: tuple[int, ...] = ()  # places of the terms, stop words counted
    boost: float = 1.0
    distance: int = 0
    op: str = ""


def analyze(text: str, field: str | None = None, fields: dict[str, str] = X.FIELDS) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Terms of a query word, by the analyzer of its field and without that one's stop words, and their places with them."""
    how = X.analyzer_of(field, fields)
    kept = [(t, i) for i, t in enumerate(how.plain(text)) if t not in how.stop]
    return tuple(t for t, _ in kept), tuple(i for _, i in kept)


def _split(text: str) -> list[str]:
    """Clauses as written: white space separates, except inside quotation marks, slashes and after a backslash."""
    out, cur, i, quote = [], "", 0, ""
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            cur += text[i : i + 2]
            i += 2
            continue
        if quote:
            cur += c
            if c == quote:
                quote = ""
        elif c == '"' or c == "/" and (not cur or cur[-1] in "+-:"):
            quote = c
            cur += c
        elif c.isspace():
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    if cur:
        out.append(cur)
    return out


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def parse(text: str, fields: dict[str, str] = X.FIELDS) -> list[Clause]:
    """Clauses of a rewritten query. Clauses of stop words alone, or of nothing, disappear."""
    out = []
    for raw in _split(text):
        occur, s = SHOULD, raw
        if s[0] in "+-":
            occur, s = (MUST if s[0] == "+" else MUST_NOT), s[1:]
        if not s:
            continue
        boost, distance, field = 1.0, 0, None
        if not (s[0] in '"/'):
            m = re.match(r"([A-Za-z_]\w*):(?=.)", s)
            if m:
                field, s = m.group(1), s[m.end() :]
        if field and (m := _RANGE.match(s)):
            out.append(Clause(occur, "range", field, m.group(2), op=m.group(1)))
            continue
        if m := re.search(r"(?<=[^\\])\^(\d+(?:\.\d+)?)$", s):
            boost, s = float(m.group(1)), s[: m.start()]
        if s[0] == '"':
            body = _unescape(s[1:-1] if len(s) > 1 and s[-1] == '"' else s[1:])
            terms, offsets = analyze(body, field, fields)
            if terms:
                out.append(Clause(occur, "phrase" if len(terms) > 1 else "term", field, body, terms, offsets, boost))
            continue
        if s[0] == "/" and s[-1] == "/" and len(s) > 2:
            out.append(Clause(occur, "regex", field, s[1:-1], boost=boost))
            continue
        if m := re.search(r"(?<=[^\\])~(\d?)$", s):
            distance, s = int(m.group(1) or 1), s[: m.start()]
            out.append(Clause(occur, "fuzzy", field, _unescape(s), (_unescape(s),), (0,), boost, distance))
            continue
        if re.search(r"(?<!\\)[*?]", s):
            out.append(Clause(occur, "wildcard", field, s, boost=boost))
            continue
        s = _unescape(s)
        terms, offsets = analyze(s, field, fields)
        if terms:
            out.append(Clause(occur, "term", field, s, terms, offsets, boost))
    return out


def wildcard_regex(pattern: str) -> str:
    """A whole-term pattern: * for any characters, ? for one, a backslash for the character itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c[-1]) for c in re.findall(r"\\.|.", pattern, re.S)) + "$"
