"""Lines repeated across the documents of one site (p6).

Equal documents of a source are collapsed first, with their number. A line is then counted once per collapsed
document, over the number of documents, of different texts and of publication days that hold it, so that
either measure can decide: ``found`` follows the stated rule (different documents), ``clean`` asks for
different texts and days as well, so that a republished article is not taken for boilerplate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from mnemora.runtime import cut, lookup_join, map_arrow

#: A line is repeated from this number of different documents of its source on.
MIN_DOCS = 5
#: For ``clean``: different texts and different days of capture that must hold the line too.
MIN_TEXTS, MIN_DAYS = 5, 2


_LINES = "doc_id long, line_no int, first boolean, k1 long, k2 long, cluster long, day int"


def norm(line: str) -> str:
    """Letter case, white space at the ends and kind and length of white space inside do not matter."""
    return " ".join(line.lower().split())


def line_keys(source: str, text: str) -> tuple[list[int], list[bytes]]:
    """Numbers of the lines of ``text`` that are not empty, and for each 128 bits of (source, line)."""
    start = source.encode("utf-8", "replace") + b"\0"
    at, keys = [], []
    for i, x in enumerate(text.lower().split("\n")):
        if words := x.split():
            at.append(i)
            keys.append(xxh3_128_digest(start + " ".join(words).encode("utf-8", "replace")))
    return at, keys


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            b = whole.slice(start, 2048)
            at, first, keys, clusters, n = [], [], [], [], []
            for source, text in zip(b.column("source").to_pylist(), b.column("text").to_pylist()):
                i, k = line_keys(source, text)
                at += i
                n.append(len(i))
                seen = set()
                first += [not (x in seen or seen.add(x)) for x in k]
                keys += k
                clusters.append(xxh3_64_intdigest(b"".join(k)) >> 1)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(b.num_rows), n)
            cols = [b.column("doc_id").take(pa.array(row)), pa.array(at, pa.int32()), pa.array(first, pa.bool_()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.array(clusters, np.int64)[row]), b.column("day").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "line_no", "first", "k1", "k2", "cluster", "day"])


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, first, k1, k2, cluster, day) of all lines that are not empty after ``norm``: k1 and
    k2 stand for (source, line), ``cluster`` for all lines of the document in their order, ``first`` marks a line's first place in its document."""
    day = F.unix_date(F.to_date("captured_at")) if "captured_at" in docs.columns else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", day.alias("day"))
    return map_arrow(rows.where("text is not null and source is not null and doc_id is not null"), _hash_lines, _LINES)


def counted(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, n_docs, n_texts, n_days) of the lines in at least ``min_docs`` documents of one source.

    First documents of equal lines collapse into one cluster (per line: number of documents, first day), with
    partial aggregation before the shuffle; then each line is counted over its clusters and their days. The
    set of days of a line is bounded by the calendar."""
    clusters = lines(docs).where("first").groupBy("k1", "k2", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("day"))
    total = clusters.groupBy("k1", "k2").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"), F.size(F.collect_set("day")).alias("n_days"))
    return total.where(F.col("n_docs") >= min_docs)


def parted(text: str, drop: set[int]) -> tuple[list[str], list[str]]:
    """Lines of a text without those of the given numbers, and these."""
    raw = text.split("\n")
    return ([x for i, x in enumerate(raw) if i not in drop], [raw[i] for i in drop]) if drop else (raw, [])


def repeated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2) of the same lines, for callers that need no different texts or days."""
    return lines(docs).where("first").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k1", "k2")


#: Lines of all sources that a Python worker may hold at once (16 bytes each, so 8 MB at most).
HELD_LINES = 1 << 19


def marked(docs: DataFrame, often: DataFrame):
    """(docs with a column ``gone``, content): ``content(source, text, gone)`` gives the kept and
    the dropped lines of a text.

    ``often`` has unique k1, k2 and is materialised. Up to HELD_LINES keys are broadcast, and ``gone`` is null;
    beyond that the numbers of a document's repeated lines are joined to it."""
    if often.count() <= HELD_LINES:
        keys = frozenset(struct.pack("<qq", r.k1, r.k2) for r in often.select("k1", "k2").toLocalIterator())
        shared = docs.sparkSession.sparkContext.broadcast(keys)

        def content(source, text, gone=None) -> tuple[list[str], list[str]]:
            held = shared.value
            if not held or source is None:
                return text.split("\n"), []
            at, k = line_keys(source, text)
            return parted(text, {i for i, x in zip(at, k) if x in held})

        return docs.withColumn("gone", F.lit(None).cast("array<int>")), content

    def content(source, text, gone=None) -> tuple[list[str], list[str]]:
        return parted(text, set(gone if gone is not None else ()))

    drop = lookup_join(lines(docs).select("doc_id", "line_no", "k1", "k2"), often.select("k1", "k2"), ["k1", "k2"])
    return docs.join(drop.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "doc_id", "left"), content


def found(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """p6_found: (doc_id, line_no) of each line in at least ``min_docs`` different documents of its source.

    A null text or source has no lines; lines empty after ``norm`` are no cases. A line twice in one document
    counts once and comes out twice. ``doc_id`` is taken to be unique. Empty tables give no rows; columns
    other than doc_id, source, text and captured_at are ignored."""
    often = cut(counted(docs, min_docs).select("k1", "k2"))
    return lookup_join(lines(docs).select("doc_id", "line_no", "k1", "k2"), often, ["k1", "k2"]).select("doc_id", "line_no")


def _dated(docs: DataFrame) -> DataFrame:
    """Documents without a date where their source has fewer than MIN_DAYS days of capture, as these tell nothing."""
    rows = docs.select("doc_id", "source", "text", *[c for c in ("captured_at",) if c in docs.columns])
    if "captured_at" not in docs.columns:
        return rows
    few = rows.where("source is not null").groupBy("source").agg(F.countDistinct(F.to_date("captured_at")).alias("days")).where(F.col("days") < MIN_DAYS)
    few = cut(few.select("source", F.lit(True).alias("few")))
    return lookup_join(rows, few, ["source"], "left", 128).select("doc_id", "source", "text", F.when(F.col("few").isNull(), F.col("captured_at")).alias("captured_at"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_texts: int = MIN_TEXTS, min_days: int = MIN_DAYS) -> DataFrame:
    """p6_clean: (doc_id, text) of every document without the lines that stand in ``min_docs`` documents,
    ``min_texts`` different texts and on ``min_days`` days. A null captured_at is no day; where a line has none, or its
    source was captured on fewer than MIN_DAYS days, the different texts decide alone. A null text stays null. The kept
    lines come back in their order; one document's lines are gathered, never those of a source."""
    enough = (F.col("n_texts") >= min_texts) & ((F.col("n_days") >= min_days) | (F.col("n_days") == 0))
    often = cut(counted(_dated(docs), min_docs).where(enough).select("k1", "k2"))
    drop = lookup_join(lines(docs).select("doc_id", "line_no", "k1", "k2"), often, ["k1", "k2"]).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    out = docs.select("doc_id", "text").join(drop, "doc_id", "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains("gone", p["i"]))
    return out.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n")).alias("text"))
