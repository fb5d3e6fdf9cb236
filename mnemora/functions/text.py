"""Analysis and small text functions, all of them built-in column expressions, with the plain functions that read queries
in the same way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, marks, digits and _, joined by single dots or apostrophes inside.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[.'’][\p{L}\p{M}\p{N}_]+)*"
#: Signs that are words by themselves, as their scripts set no spaces.
SIGN = r"([\p{IsHan}\p{IsHiragana}]\p{M}*)"
# English stop words.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def tokens(c: Column) -> Column:
    """All tokens in order, stop words included, so that positions count them."""
    apart = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SIGN, " $1 ")
    return F.regexp_extract_all(apart, F.lit(TOKEN), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The same of a plain text."""
    import regex

    return regex.findall(TOKEN, regex.sub(SIGN, r" \1 ", text.lower()))


def terms(c: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def single(c: Column) -> Column:
    """The whole value as one lower-case token."""
    return F.array(F.lower(c))


def fields(c: Column) -> Column:
    """Split at white space, without empty pieces."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def truncate(c: Column, n: int) -> Column:
    """At most n characters, with a mark where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("[..]"))).otherwise(c)


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def format_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def fallback(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


@dataclass(frozen=True)
class Analyzer:
    """How a field is cut into terms, as a column and for a plain text of a query, and which terms are dropped."""

    column: Callable[[Column], Column]
    plain: Callable[[str], list[str]]
    stop: tuple[str, ...] = ()


#: Analyzers by name; further ones can be registered.
ANALYZERS = {"words": Analyzer(tokens, tokens_of, tuple(STOP_WORDS)), "single": Analyzer(single, lambda s: [s.lower()])}
#: Indexed fields of a document and their analyzers.
FIELDS = {"url": "single", "title": "words", "text": "words"}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    """A name that is known already is refused."""
    if name in ANALYZERS:
        raise ValueError(f"there is an analyzer {name!r} already")
    ANALYZERS[name] = analyzer


def analyzer_of(field: str | None, fields: dict[str, str]) -> Analyzer:
    return ANALYZERS[fields.get(field or "", "words")]
