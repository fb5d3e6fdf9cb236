"""Duplicates hidden by formatting differences (p3).

Canonical records are range-partitioned by (key, id) and sorted externally; every partition is then scanned
once, comparing full keys of neighbours, and emits one row per copy or one per class. Because the range
bounds include the id, a key with a third of all rows is spread over many partitions; the run that continues
over a partition border is mended from one summary row per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import cut, lookup_join, map_arrow

#: Rows of one range partition aimed at.
ROWS_PER_PARTITION = 1_000_000
#: Prefixes of search terms that are free to move inside a query (fixed values).
FIELD_PREFIXES = ("url:", "title:", "text:")

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_DROP = r"[^\p{L}\p{N}]+"
_SEP, _PART = "\x01", "\x02"


def _fold(c: Column) -> Column:
    return F.lower(F.upper(c))


def link_key(url: Column) -> Column:
    """Letters and digits of the part before the first ``?``, then the sorted multiset of parameters."""
    u = _fold(url)
    head = F.regexp_replace(F.substring_index(u, "?", 1), _DROP, "")
    tail = F.when(F.instr(u, "?") > 0, F.expr("substring(__u, instr(__u, '?') + 1)"))
    return F.concat(head, F.lit(_SEP), F.coalesce(_params(tail), F.lit("")))


def _params(tail: Column) -> Column:
    each = F.transform(F.split(tail, "&"), lambda p: F.regexp_replace(p, _DROP, ""))
    return F.array_join(F.array_sort(F.filter(each, lambda p: p != "")), _PART)


def query_key(query: Column) -> Column:
    """Ordered plain terms, then the sorted multiset of field terms; ``-`` in front and every ``*`` are kept."""
    terms = F.filter(F.split(_fold(query), _SPACE), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    is_field = lambda t: t.rlike(r"^[-+]?(" + "|".join(FIELD_PREFIXES) + ")")
    norm = lambda t: F.concat(F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.regexp_replace(t, r"[^\p{L}\p{N}*]+", ""))
    plain = F.transform(F.filter(terms, lambda t: ~is_field(t)), norm)
    field = F.array_sort(F.transform(F.filter(terms, is_field), norm))
    return F.concat(F.array_join(plain, _PART), F.lit(_SEP), F.array_join(field, _PART))


def canonical(links: DataFrame, histories: DataFrame) -> DataFrame:
    """(table_name, id, key) of both tables; rows with a null value or null id are no records."""
    a = links.select(F.lit("links").alias("table_name"), F.col("id").cast("long").alias("id"), _fold(F.col("url")).alias("__u"))
    a = a.filter("id is not null and __u is not null").select("table_name", "id", F.concat(F.lit("l"), link_key(F.col("__u"))).alias("key"))
    b = histories.filter("id is not null and query is not null")
    b = b.select(F.lit("histories").alias("table_name"), F.col("id").cast("long").alias("id"), F.concat(F.lit("h"), query_key(F.col("query"))).alias("key"))
    return a.unionByName(b)


_SCAN = "table_name string, keep_id long, copy_id long, n long, border binary"


def _scan(per_copy: bool):
    """Scans one sorted partition, comparing full keys of neighbours. Emits a row per copy (the first id of its run
    as keep_id), or else per run with its number of records. ``border`` is a digest of the key in the first run,
    which may go on from the partition before; rows without a table name tell where first and last run begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = last = name = begin = mark = None
        n = 0

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["table_name", "keep_id", "copy_id", "n", "border"])

        for b in batches:
            out: list[tuple] = []
            for i, k, t in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), b.column("table_name").to_pylist()):
                if k != key:
                    if key is not None and not per_copy:
                        out.append((name, head, None, n, mark))
                    mark = _digest(k) if key is None else None
                    key, head, name, n = k, i, t, 1
                    if mark:
                        begin = (i, mark)
                        if per_copy:
                            out.append((t, i, i, 1, mark))
                elif i == last:  # the same id again is one record
                    continue
                else:
                    n += 1
                    if per_copy:
                        out.append((t, head, i, 1, mark))
                last = i
            if out:
                yield rows(out)
        if key is not None:
            out = [] if per_copy else [(name, head, None, n, mark)]
            ends = {(head, mark or _digest(key)), begin}
            yield rows(out + [(None, i, None, 0, d) for i, d in sorted(ends)])

    return run


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "replace")).digest()


def _runs(records: DataFrame, n_partitions: int, per_copy: bool) -> DataFrame:
    """Rows of ``_scan`` with keep_id mended over partition borders. The scan is written out once, so that rows and
    border rows come from one and the same range partitioning; of the latter there are two per partition."""
    parts = records.select("table_name", "id", "key").repartitionByRange(n_partitions, "key", "id")
    scanned = cut(map_arrow(parts.sortWithinPartitions("key", "id"), _scan(per_copy), _SCAN))
    heads = scanned.where("table_name is null").groupBy("border").agg(F.min("keep_id").alias("head"))
    rows = scanned.where("table_name is not null")
    at_border = lookup_join(rows.where("border is not null"), heads, ["border"], "left")
    mended = rows.where("border is null").withColumn("head", F.lit(None).cast("long")).unionByName(at_border)
    return mended.select("table_name", F.coalesce("head", "keep_id").alias("keep_id"), "copy_id", "n")


def _partitions(links: DataFrame, histories: DataFrame, n: int | None) -> int:
    least = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n or max(least, -(-(links.count() + histories.count()) // ROWS_PER_PARTITION))


def found(links: DataFrame, histories: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """p3_found: one row per copy with the smallest id of its class.

    Null urls and queries are no records; an empty one is a record with the empty key. Equal ids with equal
    keys count once. Other columns of the inputs are ignored, whatever their names. Empty tables give no rows."""
    runs = _runs(canonical(links, histories), _partitions(links, histories, n_partitions), True)
    return runs.where("keep_id <> copy_id").select("table_name", "keep_id", "copy_id")


def counts(links: DataFrame, histories: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """p3_counts: one row per class: its representative and its exact number of copies (itself included). The scan
    emits one row per run, however many copies it has. See ``found`` for nulls and empty tables."""
    runs = _runs(canonical(links, histories), _partitions(links, histories, n_partitions), False)
    return runs.groupBy("table_name", "keep_id").agg(F.sum("n").alias("n_copies"))
