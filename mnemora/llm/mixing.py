"""Mixing sources to target weights (p8), by pivotal dependent rounding.

From the sizes of the collections follows how many copies of each of its documents a collection needs, a number
that is rarely whole. Its fractional part is the document's probability of one more copy. Pairs of documents of
one collection pass probability on to each other, in tokens, at random and without changing expectations, until
one of the two is whole; what stays fractional, at most one document per collection and node, goes up a tree of
distributed reductions. The copied tokens so miss a collection's target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from mnemora.llm import bpe
from mnemora.runtime import cut, map_arrow

#: Documents of a leaf aimed at, and nodes that are combined in one step of the tree.
LEAF_DOCS, FANOUT = 100_000, 32
SEED = 20230101
_EPS = 1e-9


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Copies needed per document of each collection.

    Targets count as shares of their sum over the collections that have tokens; the total is the largest at which
    no collection needs more than its allowed repeats, so that all of these shares can be met."""
    have = {c: s for c, (s, r) in targets.items() if available.get(c, 0) > 0 and s > 0 and r > 0}
    if not have:
        return {}
    whole = sum(have.values())
    total = min(targets[c][1] * available[c] / (s / whole) for c, s in have.items())
    return {c: min(float(targets[c][1]), total * s / whole / available[c]) for c, s in have.items()}


def _coin(a: int, b: int) -> float:
    return xxh3_64_intdigest(b"%d %d %d" % (SEED, a, b)) / 2.0**64


def pivot(a: tuple[int, int, float], b: tuple[int, int, float]) -> tuple[list[tuple[int, int, int]], tuple[int, int, float] | None]:
    """One step for two documents (id, size, probability) of a collection: moves tokens of probability from one
    to the other until one is whole. Gives the settled (id, size, 0 or 1) and what is left."""
    (i, m, p), (j, n, q) = a, b
    up = min((1 - p) * m, q * n)  # tokens that a can take from b
    down = min(p * m, (1 - q) * n)
    move = up if _coin(i, j) * (up + down) < down else -down
    p, q = p + move / m, q - move / n
    settled, left = [], None
    for k, size, x in ((i, m, p), (j, n, q)):
        if x < _EPS or x > 1 - _EPS:
            settled.append((k, size, int(x > 0.5)))
        else:
            left = (k, size, x)
    return settled, left


_ROW = "doc_id long, collection string, n_tokens long, extra int, p double, node long"
_NAMES = ["doc_id", "collection", "n_tokens", "extra", "p", "node"]


def _reduce(last: bool):
    """Streams a node's open documents; emits settled ones (extra 0 or 1) and, per collection, the one left open
    (extra null). At the root the last one is settled by its probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        open_: dict[str, tuple[int, int, float]] = {}

        def rows(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int64()))], _NAMES)

        for b in batches:
            out = []
            for i, c, n, p in zip(*(b.column(x).to_pylist() for x in ("doc_id", "collection", "n_tokens", "p"))):
                if p < _EPS or p > 1 - _EPS:
                    out.append((i, c, n, int(p > 0.5), None, node))
                    continue
                if c not in open_:
                    open_[c] = (i, n, p)
                    continue
                settled, left = pivot(open_.pop(c), (i, n, p))
                out += [(k, c, size, x, None, node) for k, size, x in settled]
                if left:
                    open_[c] = left
            if out:
                yield rows(out)
        if open_:
            yield rows([(i, c, n, int(_coin(i, i) < p) if last else None, None if last else p, node) for c, (i, n, p) in sorted(open_.items())])

    return run


def sized(docs: DataFrame, targets: DataFrame, directory: str = bpe.TOKENIZERS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, collection, n_tokens) of the documents of targeted collections, repeated ids once."""
    names = targets.where("collection is not null").select("collection").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "collection", "text").where("doc_id is not null and collection is not null")
    rows = rows.join(F.broadcast(names), "collection", "left_semi")  # a row per target, a table of fixed size
    return bpe.sizes(rows, ["doc_id", "collection"], directory, vocabulary)


def mix(docs: DataFrame, targets: DataFrame, directory: str = bpe.TOKENIZERS, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: (doc_id, collection, n_tokens, copies) of the documents used at least
    once. shares: (collection, target_share, available_tokens, selected_tokens, share, documents, copies) with one
    row per target, zeros where nothing is available.

    Sizes are token counts as in p7_ids. Documents with a null collection, one without a target, or no tokens take
    no part; a null text has no tokens. Of several targets for a collection the first by share counts. Targets with a
    null share, or null or no allowed repeats count as 0. Empty tables give an empty selection. doc_id is taken to be
    unique. The result is the same for the same rows, however they are stored."""
    goal = targets.where("collection is not null").groupBy("collection").agg(F.max_by(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r")), F.coalesce("target_share", F.lit(0.0))).alias("t"))
    goals = {r.collection: (float(r.t.s), int(r.t.r)) for r in goal.collect()}  # one row per target
    base = cut(sized(docs, targets, directory, vocabulary).where("n_tokens > 0"))
    available = {r.collection: r.n for r in base.groupBy("collection").agg(F.sum("n_tokens").alias("n")).collect()}
    copies = plan(available, goals)
    spark = docs.sparkSession
    rate = spark.createDataFrame([(c, int(r + _EPS), max(0.0, r - int(r + _EPS))) for c, r in copies.items()] or [], "collection string, base int, p double")
    rows = base.join(F.broadcast(rate), "collection")
    tree = rows.select("doc_id", "collection", "n_tokens", F.lit(None).cast("int").alias("extra"), "p", F.lit(0).cast("long").alias("node"))
    nodes = max(1, -(-base.count() // LEAF_DOCS))
    leaf = F.pmod(F.xxhash64("doc_id"), F.lit(nodes)).cast("int")
    level = cut(map_arrow(tree.repartitionById(nodes, leaf).sortWithinPartitions("collection", "doc_id"), _reduce(nodes == 1), _ROW))
    done = [level.where("extra is not null")]
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        up = level.where("extra is null").withColumn("to", F.floor(F.col("node") / FANOUT))
        up = up.repartitionById(nodes, F.col("to").cast("int")).sortWithinPartitions("collection", "doc_id").drop("to")
        level = cut(map_arrow(up, _reduce(nodes == 1), _ROW))
        done.append(level.where("extra is not null"))
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    selection = extra.join(F.broadcast(rate.select("collection", "base")), "collection").select("doc_id", "collection", "n_tokens", (F.col("base") + F.col("extra")).cast("int").alias("copies"))
    selection = selection.where("copies > 0")
    used = selection.groupBy("collection").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("selected_tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))
    there = base.groupBy("collection").agg(F.sum("n_tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = goal.select("collection", F.col("t.s").alias("target_share")).join(there, "collection", "left").join(used, "collection", "left")
    report = report.select("collection", "target_share", *map(zero, ("available_tokens", "selected_tokens", "documents", "copies")))
    total = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    report = report.withColumn("share", F.when(total > 0, F.col("selected_tokens") / total).otherwise(F.lit(0.0)))
    return selection, report


def selection(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    return mix(docs, targets, **how)[0]


def shares(docs: DataFrame, targets: DataFrame, **how) -> DataFrame:
    return mix(docs, targets, **how)[1]
