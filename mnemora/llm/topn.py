"""Top N items within every group (p5), by secondary sort.

Every input partition is sorted by (group, score descending, item) and streamed once, keeping at most N rows
per group; only those are hash-partitioned by group, sorted and streamed again. A group with a third of all
rows so sends at most N rows per input partition, and no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.runtime import map_arrow


def _first_rows(n: int):
    """Streams batches sorted by (group, score desc, item); passes the first n different rows of each group.
    Between batches only the last row and the number of rows passed of its group are kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, passed = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, s, i = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            new = np.empty(len(g), bool)  # a new group begins
            rep = np.empty(len(g), bool)  # the row before again
            new[1:] = g[1:] != g[:-1]
            rep[1:] = ~new[1:] & (s[1:] == s[:-1]) & (i[1:] == i[:-1])
            new[0] = before is None or g[0] != before[0]
            rep[0] = not new[0] and (s[0], i[0]) == before[1:]
            kept = np.cumsum(~rep)
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            base = np.where(new[start], kept[start] - 1, -passed)  # rows counted before this group in this batch
            rank = kept - base
            if (out := b.filter(pa.array(~rep & (rank <= n)))).num_rows:
                yield out
            before, passed = (g[-1], s[-1], i[-1]), int(rank[-1])

    return scan


def top_n(df: DataFrame, group: str, score: str, item: str, n: int = 5) -> DataFrame:
    """(group, score, item) of the first ``n`` rows of every group by score from high to low, then item from
    low to high.

    Rows equal in all three count once. Rows with a null group, score or item are left out. Score and item
    must be integers. ``n`` < 1 and an empty table give no rows. Further columns are not read."""
    cols = [F.col(f"`{c}`").cast("long").alias(a) for c, a in ((group, "g"), (score, "s"), (item, "i"))]
    rows = df.select(*cols).where("g is not null and s is not null and i is not null")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in "gsi"])
    local = map_arrow(rows.sortWithinPartitions(*order), _first_rows(n), schema)
    merged = map_arrow(local.repartition("g").sortWithinPartitions(*order), _first_rows(n), schema)
    return merged.select(F.col("g").alias(group), F.col("s").alias(score), F.col("i").alias(item))
