"""URL columns. Patterns are used instead of parse_url, which rejects hosts and paths that browsers accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def is_valid(url: Column) -> Column:
    """Not null, with a scheme and a host."""
    return F.coalesce(url.rlike(VALID), F.lit(False))


def host(url: Column) -> Column:
    """host[:port], or the empty string."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def strip_fragment(url: Column) -> Column:
    """Without a non-empty fragment; a bare trailing # stays."""
    return F.regexp_replace(url, "#.+$", "")


def has_base(url: Column, base: str) -> Column:
    """Inside the service's own address space (case-sensitive)."""
    return F.coalesce(url.startswith(base.rstrip("/") + "/"), F.lit(False))


def base_url(configured: Column, address: Column) -> Column:
    """The configured base, or http://address; one trailing slash is dropped."""
    return F.regexp_replace(F.when(F.coalesce(configured, F.lit("")) == "", F.concat(F.lit("http://"), address)).otherwise(configured), "/$", "")


def join_base(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))


def websocket(base: Column) -> Column:
    return F.concat(F.lit("ws://"), host(base), F.lit("/search"))


def encode(text: Column) -> Column:
    """Percent-encoding of UTF-8 with %20 for a space."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_engine(template: str, query: Column) -> Column:
    """The first {query} of the template replaced by the encoded query."""
    head, found, tail = template.partition("{query}")
    return F.concat(F.lit(head), encode(query), F.lit(tail)) if found else F.lit(template)


def query_of(page_url: Column) -> Column:
    """The decoded parameter q of a page address."""
    return F.url_decode(F.regexp_extract(page_url, r"[?&]q=([^&#]*)", 1))
