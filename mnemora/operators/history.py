"""Click history: links, queries and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.rules import Rules
from mnemora.runtime import cut

TOP = 20


def deduplicated(clicks: DataFrame) -> DataFrame:
    """Each click once, as first received; clicks without address or query are left out."""
    rest = F.struct("received_at", *[c for c in clicks.columns if c != "received_at"])
    once = clicks.groupBy("click_id").agg(F.min(rest).alias("r")).select("r.*")
    return once.where("url is not null and query is not null")


def resolved(clicks: DataFrame, rules: Rules) -> DataFrame:
    return clicks.withColumn("query", rules.resolve_column(F.col("query")))


def links(clicks: DataFrame) -> DataFrame:
    """One row per address with the title of its first click."""
    return clicks.groupBy("url").agg(F.min_by(F.struct("title"), F.struct("ts", "click_id")).alias("t")).select("url", F.col("t.title").alias("title"))


def histories(clicks: DataFrame) -> DataFrame:
    return clicks.select("query").distinct()


def counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("query", "url").agg(F.count(F.lit(1)).alias("count"))


def merge_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored counts plus those of new clicks, set-based and exact."""
    return stored.unionByName(new).groupBy("query", "url").agg(F.sum("count").alias("count"))


def merge_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Unknown addresses are added; the title of a known one stays."""
    return stored.unionByName(new.join(stored, "url", "left_anti"))


def look_up_or_add(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(id, key, ...) of every new key: of known ones as stored, of unknown ones with the next ids, in the order of the
    keys. ``stored`` has an id and a unique key; ids are given out over a range partitioning, in two steps, so that no
    task sees all keys."""
    fresh = new.select(key).where(F.col(key).isNotNull()).distinct()
    known = stored.join(fresh, key, "left_semi").select("id", key)
    unknown = cut(fresh.join(stored.select(key), key, "left_anti").repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r.n for r in unknown.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    if not sizes:
        return known
    base, start = stored.agg(F.max("id")).first()[0] or 0, {}
    for p in sorted(sizes):
        start[p], base = base, base + sizes[p]
    first = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return known.unionByName(unknown.select((first[F.col("__part")] + place).cast("long").alias("id"), key))


def first_by(df: DataFrame, key: str) -> DataFrame:
    """The row with the smallest key, or none."""
    return df.where(F.col(key).isNotNull()).orderBy(key).limit(1)


def top_links(history_links: DataFrame, links_: DataFrame, histories_: DataFrame, query: str, limit: int = TOP) -> DataFrame:
    """(url, title, count) of a query's most clicked links. The query's filter reaches all three scans: the id is
    looked up first, so the bridge table is read for one history only."""
    one = histories_.where(F.col("query") == query).select(F.col("id").alias("history_id"))
    rows = history_links.select("history_id", "link_id", "count").join(F.broadcast(one), "history_id", "left_semi")  # query is unique
    rows = rows.groupBy("history_id", "link_id").agg(F.max("count").alias("count"))  # repeated rows count once
    return rows.join(links_.select(F.col("id").alias("link_id"), "url", "title"), "link_id").select("url", "title", "count").orderBy(F.desc("count"), "url").limit(limit)


def top_by_query(counts_: DataFrame, links_: DataFrame, limit: int = TOP) -> DataFrame:
    """(query, rank, url, title, count): the most clicked links of every query."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("count"), "url"))
    best = counts_.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.join(links_, "url").select("query", "rank", "url", "title", "count")


def nested(counts_: DataFrame, links_: DataFrame, limit: int = TOP) -> DataFrame:
    """(query, links array<struct<rank,url,title,count>>), at most ``limit`` links each."""
    rows = top_by_query(counts_, links_, limit)
    return rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "url", "title", "count"))).alias("links"))
