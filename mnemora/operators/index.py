"""The inverted index as a postings table.

One row per (document, field, term) with frequency and positions. Stored sorted by (field, term), its Parquet
statistics let a search read little more than the row groups of its terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schemas, storage
from mnemora.functions import text as X
from mnemora.runtime import cut, lookup_join

#: Stands for all fields in stored document frequencies.
ANY_FIELD = "*"


def postings(docs: DataFrame, fields: dict[str, str] = X.FIELDS) -> DataFrame:
    """Postings of the given fields, each by its analyzer: by default url as one lower-case token, title and text as words
    without stop words. A filter on field or term that follows is applied to the single words, before the aggregation
    and its shuffle."""
    how = {f: X.ANALYZERS[a] for f, a in fields.items() if f in docs.columns}
    sides = docs.select("url", *[a.column(F.col(f)).alias(f"__{f}") for f, a in how.items()])
    kept = lambda f, a: F.size(F.filter(F.col(f"__{f}"), lambda w: ~w.isin(list(a.stop))) if a.stop else F.col(f"__{f}"))
    sides = sides.withColumns({f"__n_{f}": kept(f, a) for f, a in how.items()})
    each = sides.select(
        "url",
        reduce(lambda a, b: a + b, [F.col(f"__n_{f}") for f in how]).alias("all_len"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("words"), F.col(f"__n_{f}").alias("field_len")) for f in how])).alias("f"),
    )
    words = each.select("url", "all_len", F.col("f.field").alias("field"), F.col("f.field_len").alias("field_len"), F.posexplode("f.words").alias("at", "term"))
    for stop in dict.fromkeys(a.stop for a in how.values() if a.stop):
        words = words.where(~F.col("field").isin([f for f, a in how.items() if a.stop == stop]) | ~F.col("term").isin(list(stop)))
    return words.groupBy("url", "field", "term").agg(F.count(F.lit(1)).cast("int").alias("freq"), F.sort_array(F.collect_list(F.col("at").cast("int"))).alias("positions"), F.first("field_len").alias("field_len"), F.first("all_len").alias("all_len"))


def words(docs: DataFrame, fields: dict[str, str] = X.FIELDS) -> DataFrame:
    """(url, words): all words of the given fields of each document as they are in ``postings``, with repetitions."""
    kept = lambda f, a: F.filter(a.column(F.col(f)), lambda w: ~w.isin(list(a.stop))) if a.stop else a.column(F.col(f))
    return docs.select("url", F.concat(*[kept(f, X.ANALYZERS[a]) for f, a in fields.items() if f in docs.columns]).alias("words"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_len(posts: DataFrame) -> DataFrame:
    return posts.groupBy("url", "field").agg(F.max("field_len").alias("field_len"))


def any_doc_freq(posts: DataFrame) -> DataFrame:
    """Document frequencies per field, and over all fields (ANY_FIELD)."""
    each = doc_freq(posts)
    every = posts.select("url", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return each.unionByName(every.withColumn("field", F.lit(ANY_FIELD)))


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The stored postings, or an empty table where nothing is stored yet."""
    return storage.stored(spark, path, schemas.POSTING)


def current(stored: DataFrame, changed: DataFrame, fields: dict[str, str] = X.FIELDS) -> DataFrame:
    """Stored postings brought up to date: those of changed documents are replaced by new ones. Changed documents are
    few; nothing of the others is read but what a search filters."""
    gone = cut(changed.select("url").distinct())
    return lookup_join(stored, gone, ["url"], "left_anti", 256).select(*schemas.POSTING.names).unionByName(postings(changed, fields).select(*schemas.POSTING.names))


def write(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Stores postings range-partitioned and sorted by (field, term)."""
    cols = ["field", "term", "url"]
    parts = posts.repartitionByRange(partitions, *cols) if partitions else posts.repartitionByRange(*cols)
    parts.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)
