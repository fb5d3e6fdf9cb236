"""Near-duplicate records by an exact set-similarity join over word runs (p2), with vertical partitioning.

The runs of all documents have one global order, from rare to frequent. Its first part of each document, the
part in which a similar pair must meet, is cut into fragments at pivots of that order; every fragment is joined by
itself and yields partial overlaps, which are summed per pair. Four shuffles of packed blocks carry this:

1. ``_encode`` reads texts in blocks and makes a dictionary of runs per block; the dictionary is dealt out by ranges of
   hashes, and copies inside a block are collapsed. Documents stay with their block.
2. ``_count`` adds up document frequencies per range, and finds the representative of copies in different
   blocks; both go back to the blocks. The frequencies of one range, a sample of all runs, give the pivots.
3. ``_prefixes`` orders each document's runs by (frequency, hash) and sends the rare ones, with their positions, to the
   fragments between whose pivots they lie. A run in very many documents is split over a grid of cells.
4. ``_join`` pairs the documents of each run under length and position bounds and counts per pair; ``_sum`` adds
   up the counts of a pair over all fragments and keeps pairs that meet MEET times.

These pairs are then compared exactly. No similar pair is lost: two sets that share t runs share the first MEET
of them within the bounds used here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from mnemora.llm.packing import pack, unpack
from mnemora.runtime import cut, lookup_join, map_arrow

#: Common runs that a pair must show in the rare part of both documents.
MEET = 4
#: Words of a block; bounds the memory of a task.
BLOCK_WORDS = 2_500_000
#: Characters of text per fragment aimed at, and documents of one run per cell of its grid.
FRAGMENT_CHARS, CELL_DOCS = 6_000_000, 4096
#: Frequency up to which the postings of a run are taken to lie in the rare part of most of its documents; for
#: balancing fragments.
RARE_DOCS = 16
#: Pairs made at once in ``_join``.
PAIRS_AT_ONCE = 4_000_000
#: Default of ``found``: classes of exact copies up to this size are written out as pairs.
EXPAND = 1000

_WORD = re.compile(r"[^\W_]+")
_ROW = "dest long, kind int, block long, at long, a binary, b binary, c binary, d binary"
_FIELDS = ["dest", "kind", "block", "at", "a", "b", "c", "d"]
_DOCS, _SLICE, _COPIES, _DF, _REPS, _POSTINGS, _HEAVY, _PAIRS, _MEMBERS, _ASK, _PIVOTS = range(11)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Vocabulary(dict):
    """Words to numbers, with their hashes."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxh3_64_intdigest(word))
        return n


def _mix(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for i in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _A + h[i : i + n] * (_B if i % 2 else _C)
    out = (out ^ (out >> np.uint64(32))) * _C
    return out ^ (out >> np.uint64(29))


def run_hashes(words: list[str], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``width`` words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    return np.unique(_mix(np.array([xxh3_64_intdigest(w) for w in words], np.uint64), width))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _FIELDS)


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of a column by which the partition is sorted."""
    rows = (r for b in batches for r in b.to_pylist())
    for k, g in groupby(rows, key=lambda r: r[by]):
        yield k, list(g)


def _spread(block: int) -> int:
    """Numbers blocks so that those of one task and of neighbouring tasks fall into different partitions."""
    return (block >> 32) + (block & 0xFFFFFFFF)


def _placed(df: DataFrame, n: int, by: str) -> DataFrame:
    """Rows in the partition of their fragment or block, without collisions, sorted by it."""
    place = F.col("dest") if by == "dest" else F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF)
    return df.repartitionById(n, F.pmod(place, F.lit(n)).cast("int")).sortWithinPartitions(by)


def _encode(width: int, min_words: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        vocabulary, ids, sizes, words, total = _Vocabulary(), [], [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = _WORD.findall(t.lower())
                if len(w) < max(min_words, width):
                    continue
                ids.append(i)
                sizes.append(len(w))
                words.append(np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)))
                total += len(w)
                if total >= BLOCK_WORDS:
                    yield from block(part << 32 | made, vocabulary, ids, sizes, words)
                    made += 1
                    vocabulary, ids, sizes, words, total = _Vocabulary(), [], [], [], 0
        if ids:
            yield from block(part << 32 | made, vocabulary, ids, sizes, words)

    def block(number: int, vocabulary, ids, sizes, words) -> Iterator[pa.RecordBatch]:
        ids = np.array(ids, np.int64)
        h = np.array(vocabulary.hashes, np.uint64)[np.concatenate(words)]
        ends = np.cumsum(sizes)
        digests = [xxh3_128_digest(h[e - s : e].tobytes()) for s, e in zip(sizes, ends)]
        first: dict[bytes, int] = {}
        for j in np.argsort(ids, kind="stable").tolist():
            first.setdefault(digests[j], j)
        rep = np.array([first[x] for x in digests])
        kept = np.flatnonzero(rep == np.arange(len(ids)))
        place = np.zeros(len(ids), np.int64)
        place[kept] = np.arange(len(kept))
        copy = np.flatnonzero(rep != np.arange(len(ids)))
        owner = np.repeat(np.arange(len(ids)), sizes)
        n = len(h) - width + 1
        inside = (owner[:n] == owner[width - 1 :]) & (rep[owner[:n]] == owner[:n])
        runs = (_mix(h, width)[inside] >> np.uint64(16)).astype(np.int64)
        words_, where = np.unique(runs, return_inverse=True)
        size = max(1, len(words_))
        keys = np.unique(place[owner[:n][inside]] * size + where)
        doc, loc = keys // size, keys % size
        df = np.bincount(loc, minlength=len(words_)).astype(np.uint32)
        digest = np.frombuffer(b"".join(digests[j] for j in kept), np.int64).reshape(-1, 2)
        rows = [(_spread(number) % fragments, _DOCS, number, 0, pack(ids[kept]), pack(np.bincount(doc, minlength=len(kept)).astype(np.uint32)), pack(keys.astype(np.int64), True), pack(np.stack([ids[copy], place[rep[copy]]], 1).reshape(-1)))]
        rows.append((0, _ASK, number, 0, None, None, None, None))
        edge = np.searchsorted(words_, (np.arange(fragments + 1, dtype=np.float64) * (2**48 / fragments)).astype(np.int64))
        edge[-1] = len(words_)
        for f in range(fragments):
            a, z = edge[f], edge[f + 1]
            if z > a:
                rows.append((f, _SLICE, number, f, pack(words_[a:z], True), pack(df[a:z]), None, None))
        dest = digest[:, 0] % fragments
        for f in np.unique(dest).tolist():
            at = np.flatnonzero(dest == f)
            rows.append((f, _COPIES, number, f, pack(digest[at].reshape(-1)), pack(ids[kept][at]), pack(at.astype(np.uint32)), None))
        yield _batch(rows)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the runs of a range of hashes, and representatives of copies over all blocks. The first
    range, a sample of all runs, also tells every block how many postings lie at which frequency."""
    for _, rows in _grouped(batches, "dest"):
        out = [tuple(r[c] for c in _FIELDS) for r in rows if r["kind"] == _DOCS]
        slices = [r for r in rows if r["kind"] == _SLICE]
        level = work = np.empty(0, np.int64)
        if slices:
            parts = [unpack(r["a"]) for r in slices]
            first, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)[1:]
            df = np.bincount(number, weights=np.concatenate([unpack(r["b"]) for r in slices]))[number].astype(np.uint32)
            size, z = pack(np.array([len(first)])), 0
            for r, p in zip(slices, parts):
                a, z = z, z + len(p)
                out.append((r["dest"], _DF, r["block"], r["at"], pack(df[a:z]), pack(number[a:z].astype(np.int64), True), size, None))
            level, n = np.unique(df[first].astype(np.int64), return_counts=True)
            used = (level > 1) & (level <= CELL_DOCS)
            level, work = level[used], (n * np.minimum(level, RARE_DOCS))[used]
        for r in rows:
            if r["kind"] == _ASK:
                out.append((_spread(r["block"]), _PIVOTS, r["block"], 0, pack(level, True), pack(work), None, None))
        copies = [r for r in rows if r["kind"] == _COPIES]
        if copies:
            digest = np.concatenate([unpack(r["a"]) for r in copies]).reshape(-1, 2)
            ids, at = np.concatenate([unpack(r["b"]) for r in copies]), np.concatenate([unpack(r["c"]) for r in copies])
            block = np.repeat([r["block"] for r in copies], [len(unpack(r["b"])) for r in copies])
            order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
            new = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)]
            rep = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            moved = order[~new]
            rep = rep[~new]
            for n in np.unique(block[moved]).tolist():
                own = block[moved] == n
                out.append((_spread(n), _REPS, n, 0, pack(at[moved][own]), pack(rep[own]), None, None))
        if out:
            yield _batch(out)


def _prefixes(threshold: Fraction, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(batches, "block"):
            docs = next(r for r in rows if r["kind"] == _DOCS)
            ids, size, keys = unpack(docs["a"]), unpack(docs["b"]).astype(np.int64), unpack(docs["c"])
            rep = ids.copy()
            for r in rows:
                if r["kind"] == _REPS:
                    rep[unpack(r["a"])] = unpack(r["b"])
            copies = unpack(docs["d"]).reshape(-1, 2)
            out = []
            gone = rep != ids
            members = np.concatenate([np.stack([ids[gone], rep[gone]], 1), np.stack([copies[:, 0], rep[copies[:, 1]]], 1)])
            if len(members):
                out.append((_spread(number) % fragments, _MEMBERS, number, 0, pack(members[:, 0]), pack(members[:, 1]), None, None))
            parts = sorted((r for r in rows if r["kind"] == _DF), key=lambda r: r["at"])
            if parts:
                df, number_ = np.concatenate([unpack(r["a"]) for r in parts]), np.concatenate([unpack(r["b"]) for r in parts])
                n = [len(unpack(r["a"])) for r in parts]
                range_ = np.repeat([r["at"] for r in parts], n)
                pivots = next(r for r in rows if r["kind"] == _PIVOTS)
                fragment = place(df, (range_ + (number_ + 0.5) / np.repeat([unpack(r["c"])[0] for r in parts], n)) / fragments, unpack(pivots["a"]), unpack(pivots["b"]))
                doc, loc = keys // len(df), keys % len(df)
                order = np.argsort((doc << 32) + np.minimum(df[loc], 2**32 - 1), kind="stable")  # ties stay in order of hash
                doc, loc = doc[order], loc[order]
                start = np.cumsum(size) - size
                pos = np.arange(len(doc)) - start[doc]
                # the least overlap with any document of a length that is allowed
                least = -(-threshold.numerator * size // threshold.denominator)
                use = (pos < (size - least + MEET)[doc]) & (df[loc] > 1) & ~gone[doc]
                doc, loc, pos = doc[use], loc[use], pos[use]
                heavy = df[loc] > CELL_DOCS
                out += light(doc[~heavy], loc[~heavy], pos[~heavy], ids, size, range_ << 40 | number_, fragment)
                out += grid(doc[heavy], loc[heavy], pos[heavy], ids, size, range_ << 40 | number_, df)
            if out:
                yield _batch(out)

    def place(df: np.ndarray, within: np.ndarray, level: np.ndarray, work: np.ndarray) -> np.ndarray:
        """Fragment of each run: the order (frequency, hash) is cut where each fragment gets as many postings. ``within`` is a
        run's place among all by hash, from 0 to 1."""
        if not len(level):
            return np.zeros(len(df), np.int64)
        at = np.minimum(np.searchsorted(level, df), len(level) - 1)
        own = np.where(level[at] == df, work[at], 0)
        before = (np.cumsum(work) - work)[at] + np.where(level[at] < df, work[at], 0)
        return np.minimum((before + own * within) / work.sum() * fragments, fragments - 1).astype(np.int64)

    def light(doc, loc, pos, ids, size, token, fragment) -> list[tuple]:
        order = np.lexsort((loc, fragment[loc]))
        doc, loc, pos = doc[order], loc[order], pos[order]
        f = fragment[loc]
        cuts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else []
        out = []
        for a, z in zip(cuts, [*cuts[1:], len(f)]):
            used, di = np.unique(doc[a:z], return_inverse=True)
            out.append((int(f[a]), _POSTINGS, 0, 0, pack(token[loc[a:z]], True), pack(np.stack([ids[used], size[used]], 1).reshape(-1)), pack(di.astype(np.uint32)), pack(pos[a:z].astype(np.uint32))))
        return out

    def grid(doc, loc, pos, ids, size, token, df) -> list[tuple]:
        out = []
        for t in np.unique(loc).tolist():
            own = loc == t
            g = -(-int(df[t]) // CELL_DOCS)
            who, p = doc[own], pos[own]
            cell = (ids[who].view(np.uint64) * _A >> np.uint64(33)).astype(np.int64) % g
            for i in np.unique(cell).tolist():
                at = cell == i
                block = np.stack([ids[who[at]], size[who[at]], p[at]], 1).reshape(-1)
                for j in range(g):
                    lo, hi = min(i, j), max(i, j)
                    key = xxh3_64_intdigest(b"%d %d %d" % (token[t], lo, hi)) >> 2
                    out.append((key % fragments, _HEAVY, key, int(i == hi) + 2 * (lo == hi), pack(block), None, None, None))
        return out

    return run


def _join(threshold: Fraction, fragments: int):
    num, den = threshold.numerator, threshold.denominator

    def pairs(ids, size, pos, order_key, across=None) -> Iterator[tuple]:
        """Counts per pair of documents that share a key; the arrays are sorted by (key, size)."""
        n = len(ids)
        if n < 2:
            return
        reach = np.searchsorted(order_key, (order_key >> 24 << 24) + np.minimum((order_key & 0xFFFFFF) * den // num, 0xFFFFFF), side="right")
        count = np.maximum(reach - np.arange(n) - 1, 0)
        names, code = np.unique(ids, return_inverse=True)
        ends = np.cumsum(count)
        a = 0
        while a < n:
            done = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
            c = count[a:z]
            total = int(c.sum())
            if total:
                x = np.repeat(np.arange(a, z), c)
                y = x + 1 + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
                sx, sy = size[x], size[y]
                tau = -(-num * (sx + sy) // (num + den))
                k = np.minimum(MEET, tau)
                ok = (pos[x] < sx - tau + k) & (pos[y] < sy - tau + k) & (code[x] != code[y])
                if across is not None:
                    ok &= across[x] != across[y]
                x, y, k = code[x[ok]], code[y[ok]], k[ok]
                key = np.minimum(x, y) * len(names) + np.maximum(x, y)
                key, at, met = np.unique(key, return_index=True, return_counts=True)
                if len(key):
                    yield names[key // len(names)], names[key % len(names)], met.astype(np.uint32), k[at].astype(np.uint8)
            a = z

    def send(found) -> Iterator[pa.RecordBatch]:
        for a, b, met, k in found:
            dest = ((a.astype(np.uint64) * _A + b.astype(np.uint64) * _B) >> np.uint64(33)).astype(np.int64) % fragments
            order = np.lexsort((b, a, dest))
            a, b, met, k, dest = a[order], b[order], met[order], k[order], dest[order]
            cuts = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]])
            yield _batch([(int(dest[s]), _PAIRS, 0, 0, pack(a[s:e], True), pack(b[s:e]), pack(met[s:e]), pack(k[s:e])) for s, e in zip(cuts, [*cuts[1:], len(a)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "dest"):
            if keep := [tuple(r[c] for c in _FIELDS) for r in rows if r["kind"] == _MEMBERS]:
                yield _batch(keep)
            posts = [r for r in rows if r["kind"] == _POSTINGS]
            if posts:
                token = np.unique(np.concatenate([unpack(r["a"]) for r in posts]), return_inverse=True)[1]
                who = np.concatenate([unpack(r["b"]).reshape(-1, 2)[unpack(r["c"])] for r in posts])
                pos = np.concatenate([unpack(r["d"]) for r in posts]).astype(np.int64)
                key = (token << 24) + np.minimum(who[:, 1], 0xFFFFFF)
                order = np.argsort(key, kind="stable")
                yield from send(pairs(who[order, 0], who[order, 1], pos[order], key[order]))
            heavy = sorted((r for r in rows if r["kind"] == _HEAVY), key=lambda r: r["block"])
            for _, cell in groupby(heavy, key=lambda r: r["block"]):
                cell = list(cell)
                blocks = [unpack(r["a"]).reshape(-1, 3) for r in cell]
                who = np.concatenate(blocks)
                side = np.repeat([r["at"] & 1 for r in cell], [len(x) for x in blocks])
                order = np.argsort(who[:, 1], kind="stable")
                who, side = who[order], side[order]
                yield from send(pairs(who[:, 0], who[:, 1], who[:, 2], np.minimum(who[:, 1], 0xFFFFFF), None if cell[0]["at"] & 2 else side))

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the partial counts of every pair; passes members on."""
    for _, rows in _grouped(batches, "dest"):
        for r in rows:
            if r["kind"] == _MEMBERS:
                a, b = unpack(r["a"]), unpack(r["b"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])
        parts = [r for r in rows if r["kind"] == _PAIRS]
        if not parts:
            continue
        a, b, met, k = (np.concatenate([unpack(r[c]) for r in parts]) for c in "abcd")
        order = np.lexsort((b, a))
        a, b, met, k = a[order], b[order], met[order].astype(np.int64), k[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        ok = new[np.add.reduceat(met, new) >= k[new]]
        if len(ok):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ok), np.int32)), pa.array(a[ok]), pa.array(b[ok])], ["kind", "a", "b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [run_hashes(_WORD.findall(t.lower()), width).view(np.int64) for t in b.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["doc_id", "runs"])

    return run


def similar(docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(1, 2), min_words: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b), a < b, of class representatives whose sets of word runs have a Jaccard
    similarity of at least ``threshold``; members (doc_id, rep) of documents whose words equal those of ``rep``,
    the smallest id of their class.

    Documents with fewer than ``min_words`` words, a null text or a null doc_id take no part. doc_id is taken to
    be unique. Further columns are ignored; an empty table gives empty results."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    fragments = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // FRAGMENT_CHARS))
    encoded = map_arrow(rows, _encode(width, min_words, fragments), _ROW)
    counted = map_arrow(_placed(encoded, fragments, "dest"), _count, _ROW)
    prefixes = map_arrow(_placed(counted, fragments, "block"), _prefixes(threshold, fragments), _ROW)
    joined = map_arrow(_placed(prefixes, fragments, "dest"), _join(threshold, fragments), _ROW)
    summed = cut(map_arrow(_placed(joined, fragments, "dest"), _sum, "kind int, a long, b long"))
    candidates = summed.where("kind = 1").select("a", "b")
    members = summed.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("rep"))
    needed = cut(candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = map_arrow(lookup_join(rows, needed, ["doc_id"]), _sets(width), "doc_id long, runs array<long>")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("runs").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("runs").alias("y"))
    both = candidates.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    pairs = both.where(threshold.denominator * common >= threshold.numerator * (F.size("x") + F.size("y") - common)).select("a", "b")
    return pairs, members


def found(docs: DataFrame, expand: int | None = EXPAND, **how) -> DataFrame:
    """p2_found: (doc_id_a, doc_id_b), smaller id first, of all similar pairs.

    Pairs between representatives are written out for the members of both classes, and copies among themselves, for
    classes of up to ``expand`` documents, or of any size if it is None. The copies of a larger class are tied to its
    representative alone, by one row each; ``links`` and ``classes`` hold all pairs at every size. See ``similar`` for
    nulls and empty input."""
    pairs, members = similar(docs, **how)
    pairs = cut(pairs)
    most = 2**62 if expand is None else expand
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    small = members.join(sizes.where(F.col("n") < most), "rep", "left_semi")
    large = members.join(sizes.where(F.col("n") >= most), "rep", "left_semi")
    lists = cut(small.groupBy("rep").agg(F.sort_array(F.collect_list("doc_id")).alias("copies")))
    whole = lambda c: F.when(F.col("copies").isNull(), F.array(c)).otherwise(F.concat(F.array(c), "copies"))
    a = pairs.join(lists.withColumnRenamed("rep", "a"), "a", "left").select("b", F.explode(whole("a")).alias("p"))
    b = a.join(lists.withColumnRenamed("rep", "b"), "b", "left").select("p", F.explode(whole("b")).alias("q"))
    inside = lists.select(F.concat(F.array("rep"), "copies").alias("all")).select("all", F.posexplode("all").alias("i", "p")).select("p", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("q"))
    every = b.unionByName(inside).unionByName(large.select(F.col("rep").alias("p"), F.col("doc_id").alias("q")))
    return every.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))


def links(docs: DataFrame, **how) -> DataFrame:
    """p2_links: (class_a, class_b), smaller id first, of the similar pairs of class representatives. With ``classes``,
    which ties each document to its class, all similar pairs follow from it. See ``similar`` for nulls and empty
    input."""
    return similar(docs, **how)[0].select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """p2_classes: (doc_id, class_id, n_links), one row per document: the smallest id with the same words (its own
    id if there is none, or if it takes no part), and the number of other classes similar to its class."""
    pairs, members = similar(docs, **how)
    linked = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    out = ids.join(members, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))
    return out.join(linked, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
