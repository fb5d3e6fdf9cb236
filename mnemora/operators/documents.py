"""Documents of the archive: preparation, acceptance, upsert, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import html as H
from mnemora.functions import urls as U
from mnemora.rules import Rules

FIELDS = ("url", "title", "text", "favicon", "html")


def from_capture(captures: DataFrame) -> DataFrame:
    """Captured pages as documents: address without fragment, missing title, text and icon taken from the HTML.
    Further columns stay."""
    url = U.strip_fragment(F.col("url"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    icon = F.coalesce(F.col("favicon"), F.lit("")) if "favicon" in captures.columns else F.lit("")
    page = F.coalesce(F.col("html"), F.lit(""))
    return captures.withColumns(
        {
            "url": url,
            "title": F.when(empty("title"), H.title(page)).otherwise(F.col("title")),
            "text": F.when(empty("text"), H.text(page)).otherwise(F.col("text")),
            "favicon": F.when(icon == "", F.when(U.is_valid(url), H.favicon_url(page, url)).otherwise(F.lit(""))).otherwise(icon),
            "html": page,
        }
    )


def accepted(docs: DataFrame, rules: Rules, base_url: str) -> DataFrame:
    """Documents with a valid address that no skip pattern matches and that is not the service's own."""
    url = F.col("url")
    return docs.where(U.is_valid(url)).where(~rules.is_skipped(url)).where(~U.has_base(url, base_url))


def latest(docs: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last version of each key. Aggregation keeps one row per key before the shuffle; the result stays
    partitioned by the key, so that what groups by it later needs no shuffle."""
    others = [F.col(c) for c in docs.columns if c != key]
    rest = F.struct(*order, F.struct(*others).alias("__row"))
    last = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rest).alias("__last"))
    return last.select(*[F.col(c) if c == key else F.col(f"__last.__row.{c}") for c in docs.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """New documents replace old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def page(docs: DataFrame, number: int, size: int = 20, order: str = "url") -> DataFrame:
    """One page of a full scan in a total order."""
    return docs.orderBy(order).offset(number * size).limit(size)


def changed(versions: DataFrame, key: str, content: str, *order: str, force: str | None = None) -> DataFrame:
    """Versions whose content differs from the one before of the same key; the first always counts, and a true
    ``force`` column passes on any version."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    keep = first | ~F.col(content).eqNullSafe(before)
    if force:
        keep = keep | F.coalesce(F.col(force), F.lit(False))
    return versions.withColumn("__keep", keep).where("__keep").drop("__keep")

