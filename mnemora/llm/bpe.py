"""Encoding with a byte-level BPE vocabulary (p7).

Text is split by the vocabulary's public pattern; each piece is encoded with a segment tree over the ranks of
its neighbouring pairs, whose root yields the leftmost pair of lowest rank. A merge changes three leaves, each
in logarithmic time, so that a piece of n bytes takes O(n log n) however long it is. Encoded pieces are kept in
a bounded memo.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mnemora.runtime import map_arrow

#: Where vocabularies lie; only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept in the memo of a worker; it is emptied when full. Longer pieces are not kept.
MEMO_PIECES, MEMO_CHARS = 1 << 18, 48

_NONE = 1 << 60


def read_ranks(directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    lines = Path(directory, f"{vocabulary}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, _, b in (x.partition(b" ") for x in lines if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    part: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)  # leaf i: rank * n + i of the pair that begins at part i
    get = ranks.get
    for i in range(n - 1):
        r = get(part[i] + part[i + 1])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                return
            tree[k] = v
            k >>= 1

    def pair(i: int, j: int) -> int:
        r = get(part[i] + part[j])
        return _NONE if r is None else r * n + i

    while tree[1] != _NONE:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        part[i] += part[j]
        part[j] = b""
        after[i] = k
        if k < n:
            before[k] = i
        put(j, _NONE)
        put(i, pair(i, k) if k < n else _NONE)
        if before[i] >= 0:
            put(before[i], pair(before[i], i))
    return [ranks[p] for p in part if p]


class Encoder:
    """One per Python worker; see ``encoder``."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.find, self.memo = ranks, regex.compile(PATTERN).findall, {}

    def __missing(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode("utf-8", "replace"), self.ranks))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, miss = self.memo.get, self.__missing
        return list(chain.from_iterable(get(p) or miss(p) for p in self.find(text)))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets) of the texts."""
        get, miss, find = self.memo.get, self.__missing, self.find
        ids, offsets = [], [0]
        for t in texts:
            if t:
                ids.extend(chain.from_iterable([get(p) or miss(p) for p in find(t)]))
            offsets.append(len(ids))
        return np.array(ids, np.int32), np.array(offsets, np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(shared, key: str) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; it is kept between tasks."""
    at = (key, len(shared.value))
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(shared.value)
    return _ENCODERS[at]


def share(spark: SparkSession, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The vocabulary as a broadcast: a file of a fixed size (about 1 MB), whatever the corpus."""
    return spark.sparkContext.broadcast(read_ranks(directory, vocabulary))


def ids(docs: DataFrame, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """p7_ids: (doc_id, ids) with one row per row of ``docs``.

    A null text and an empty text have the empty list. Strings of special tokens in a text are ordinary text.
    Repeated rows stay repeated, a null doc_id stays null, other columns are not read."""
    shared, key = share(docs.sparkSession, directory, vocabulary), f"{directory}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, key)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                values, offsets = enc.batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], ["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def sizes(docs: DataFrame, keep: list[str], directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens, the length of the list of ``ids``."""
    shared, key = share(docs.sparkSession, directory, vocabulary), f"{directory}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, key)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = np.diff(enc.batch(part.column("text").to_pylist())[1])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    return map_arrow(docs.select(*keep, "text"), run, schema)
