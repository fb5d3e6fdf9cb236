"""Title, text and icon of a captured page, by patterns on its HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import urls

# Entities decoded in titles and texts; the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&amp;", "&")]
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HIDDEN = r"(?is)<(script|style|head|noscript)\b[^>]*>.*?</(script|style|head|noscript)>"
COMMENT = r"(?s)<!--.*?-->"
ICON = r"""(?i)<link\b[^>]*\brel=["'](?:[^"'>]*\s)?icon["'][^>]*>"""
HREF = r"""(?i)\bhref=["']([^"']*)["']"""


def decode(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def title(html: Column) -> Column:
    return F.trim(decode(F.regexp_extract(html, TITLE, 1)))


def text(html: Column) -> Column:
    """Visible text with single spaces; an approximation of what a browser renders."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), COMMENT, " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode(bare), r"\s+", " "))


def favicon_url(html: Column, url: Column) -> Column:
    """The first icon link, resolved against the page, else /favicon.ico of its origin."""
    href = F.regexp_extract(F.regexp_extract(html, ICON, 0), HREF, 1)
    folder = F.concat(urls.origin(url), F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:/?#]+://[^/]*(/.*)?$", 1), r"[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    resolved = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([^:]+:)", 1), href)).when(href.startswith("/"), F.concat(urls.origin(url), href)).otherwise(F.concat(folder, href))
    return F.when(F.coalesce(href, F.lit("")) == "", F.concat(urls.origin(url), F.lit("/favicon.ico"))).otherwise(resolved)


def data_url(kind: Column, content: Column) -> Column:
    """Icon bytes as a base64 data address; nothing where there are none."""
    return F.coalesce(F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content)), F.lit(""))
