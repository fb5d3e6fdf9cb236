"""Evaluation of many queries of the whole language at once, each document by itself, in a worker.

A document comes with its hits: which words, or words that match a pattern, stand in which of its fields. From them
all clauses of all queries are scored where the document lies, and only the best documents of each query leave the
task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mnemora.plans import query as Q

#: (Document, clause) pairs scored at once, and candidates held before they are cut to the best.
PAIRS_AT_ONCE, HELD = 1_000_000, 200_000
HIT = "field int, atom int, freq int, field_len int, at array<int>"
HITS = f"url string, priority boolean, stored boolean, score double, all_len int, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>"
_HIT = pa.struct([("field", pa.int32()), ("atom", pa.int32()), ("freq", pa.int32()), ("field_len", pa.int32()), ("at", pa.list_(pa.int32()))])
_SIMPLE = re.compile(r"\*([^*?\\]+)\*|([^*?\\]+)\*", re.S)
_MICRO = Decimal("0.000001")


def _wildcard(value: str):
    """Test of a wildcard as ``Q.wildcard_regex`` means it, with a dot as Java reads it."""
    if m := _SIMPLE.fullmatch(value):
        inside, start = m.groups()
        return (lambda t: inside in t) if inside else (lambda t: t.startswith(start))
    one = "[^\n\r\x85  ]"
    return re.compile("".join(one + "*" if c == "*" else one if c == "?" else re.escape(c[-1]) for c in re.findall(r"\\.|.", value, re.S))).fullmatch


def _near(word: str, most: int):
    def test(t: str) -> bool:
        if abs(len(t) - len(word)) > most:
            return False
        row = list(range(len(word) + 1))
        for i, c in enumerate(t, 1):
            old, row = row, [i]
            for j, w in enumerate(word, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != w)))
            if min(row) > most:
                return False
        return row[-1] <= most

    return test


class Plan:
    """The clauses of a set of queries. Atoms are words and patterns; scopes are atoms in one field, or in any (-1)."""

    def __init__(self, rows: list, fields: list[str]):
        self.fields = fields = [*fields, *sorted({r.field for r in rows if r.field} - set(fields))]
        self.queries = sorted({r.query_id for r in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        self.clauses = sorted(rows, key=lambda r: (number[r.query_id], r.clause))
        self.query = np.array([number[r.query_id] for r in self.clauses], np.int64)
        self.atoms: dict[tuple, int] = {}
        self.scopes: dict[tuple[int, int], int] = {}
        self.phrase_atoms, self.regexes = set(), set()
        uses: list[list[int]] = []
        for c, r in enumerate(self.clauses):
            if r.kind == "range":
                continue
            keys = [("term", t) for t in r.terms] if r.kind in ("term", "phrase") else [(r.kind, r.terms[0], r.distance)] if r.kind == "fuzzy" else [(r.kind, r.value)]
            for k in keys:
                a = self.atoms.setdefault(k, len(self.atoms))
                if r.kind == "phrase":
                    self.phrase_atoms.add(a)
                s = self.scopes.setdefault((fields.index(r.field) if r.field else -1, a), len(self.scopes))
                uses += [[]] * (s >= len(uses))
                uses[s] = [*uses[s], c]
            if r.kind == "regex":
                self.regexes.add(r.value)
        self.known: dict[str, list[int]] = {}  # what regexes match, told by ``matched``
        self.scope_of = np.full((len(fields) + 2, max(1, len(self.atoms))), -1, np.int64)  # the last row is any field, the one before a field unknown here
        for (f, a), s in self.scopes.items():
            self.scope_of[f, a] = s
        self.use_count = np.array([len(u) for u in uses], np.int64)
        self.use_start, self.use = np.cumsum(self.use_count) - self.use_count, np.array([c for u in uses for c in u], np.int64)
        self.any = np.array([f < 0 for f, _ in self.scopes], bool)
        self.idf = np.zeros(len(self.scopes))

    def matched(self, term: str, regex: str) -> None:
        self.known.setdefault(term, []).append(self.atoms["regex", regex])

    def finder(self):
        """A function from a word to its atoms."""
        tests = [(_wildcard(k[1]) if k[0] == "wildcard" else _near(k[1], k[2]), a) for k, a in self.atoms.items() if k[0] in ("wildcard", "fuzzy")]
        seen: dict[str, list[int]] = {}

        def find(t: str) -> list[int]:
            if (out := seen.get(t)) is None:
                a = self.atoms.get(("term", t))
                out = ([] if a is None else [a]) + [a for test, a in tests if test(t)] + self.known.get(t, [])
                if len(seen) < 500_000:
                    seen[t] = out
            return out

        return find


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each i, ``count[i]`` of them, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def pieces(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose work is at most ``most``, or of one alone."""
    ends, a = np.cumsum(work), 0
    while a < len(work):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def _listed(n: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), values)


def _expanded(words: pa.Array, find) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, atom) of all atoms of an array of words."""
    words = pc.dictionary_encode(words)
    atoms = [find(t) for t in words.dictionary.to_pylist()]
    n = np.array([*map(len, atoms), 0], np.int64)
    start, flat = np.cumsum(n) - n, np.array([a for x in atoms for a in x], np.int64)
    code = pc.fill_null(words.indices, len(atoms)).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(code)), n[code]), flat[ranges(start[code], n[code])]


def hits_of_documents(plan: Plan, stops: dict[str, tuple]):
    """Rows (url, priority, stored, score, all_len, w_field and n_field of each field) to HITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n_atoms = plan.finder(), max(1, len(plan.atoms))
        placed = np.isin(np.arange(n_atoms), list(plan.phrase_atoms))
        for whole in batches:
            for off in range(0, whole.num_rows, 2000):
                b = whole.slice(off, 2000)
                parts = []
                for f, stop in stops.items():
                    words = b.column(f"w_{f}")
                    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
                    doc = np.repeat(np.arange(len(words)), size)
                    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                    w, atom = _expanded(words.flatten(), lambda t, stop=frozenset(stop): [] if t in stop else find(t))
                    key = doc[w] * n_atoms + atom
                    order = np.argsort(key, kind="stable")
                    key, at = key[order], at[w][order]
                    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                    freq = np.diff(np.r_[new, len(key)])
                    d, a = key[new] // n_atoms, key[new] % n_atoms
                    keep = placed[a]
                    length = b.column(f"n_{f}").to_numpy(zero_copy_only=False)[d] if len(d) else d
                    parts.append((d, np.full(len(d), plan.fields.index(f)), a, freq, length, np.where(keep, freq, 0), at[np.repeat(keep, freq)]))
                cols = [np.concatenate([p[k] for p in parts]) for k in range(6)]
                places = np.concatenate([p[6] for p in parts])
                order = np.argsort(cols[0], kind="stable")
                first = (np.cumsum(cols[5]) - cols[5])[order]
                d, f, a, freq, length, n = (c[order] for c in cols)
                at = _listed(n, pa.array(places[ranges(first, n)], pa.int32()))
                hits = pa.StructArray.from_arrays([*(pa.array(x, pa.int32()) for x in (f, a, freq, length)), at], fields=list(_HIT))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("url", "priority", "stored", "score", "all_len")), _listed(np.bincount(d, minlength=len(b)), hits)], ["url", "priority", "stored", "score", "all_len", "hits"])

    return run


def hits_of_postings(plan: Plan):
    """Postings to their hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = plan.finder(), pa.array(plan.fields, pa.string())
        placed = np.isin(np.arange(max(1, len(plan.atoms))), list(plan.phrase_atoms))
        for b in batches:
            w, atom = _expanded(b.column("term"), find)
            at = b.column("positions").take(pa.array(w, mask=~placed[atom]))
            at = _listed(pc.fill_null(pc.list_value_length(at), 0).to_numpy(), at.flatten())
            field = pc.fill_null(pc.index_in(b.column("field"), names), len(plan.fields)).take(pa.array(w))
            yield pa.RecordBatch.from_arrays([b.column("url").take(pa.array(w)), b.column("all_len").take(pa.array(w)), field, pa.array(atom, pa.int32()), *(b.column(c).take(pa.array(w)) for c in ("freq", "field_len")), at], ["url", "all_len", "field", "atom", "freq", "field_len", "at"])

    return run


def _opened(b: pa.RecordBatch, plan: Plan):
    """doc, field, atom, freq, field_len of all hits of a batch, and their places."""
    hits = b.column("hits")
    doc = np.repeat(np.arange(len(hits)), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
    flat = hits.flatten()
    x = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
    return doc, *x, flat.field(4)


def _scoped(doc, field, atom, plan: Plan):
    """(index of the hit, scope) for the hits' own fields and for any field."""
    own, every = plan.scope_of[field, atom], plan.scope_of[-1, atom]
    at = np.concatenate([np.flatnonzero(own >= 0), np.flatnonzero(every >= 0)])
    return at, np.concatenate([own[own >= 0], every[every >= 0]])


def frequencies(plan: Plan):
    """HITS to (scope, number of documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = max(1, len(plan.scopes)), 0
        for b in batches:
            doc, field, atom, *_ = _opened(b, plan)
            at, scope = _scoped(doc, field, atom, plan)
            total = total + np.bincount(np.unique(doc[at] * n + scope) % n, minlength=n)
        if np.any(total):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["scope", "n"])

    return run


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up in the shortest decimal form, as Spark rounds."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    for i in np.flatnonzero(~(np.abs(y - np.floor(y) - 0.5) > 1e-3)):
        if np.isfinite(x[i]):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(_MICRO, ROUND_HALF_UP))
    return out


def best(plan: Plan, limit: int, boost: float, title_factor: float, priority_factor: float):
    """HITS to (query_id, url, relevance): the best documents of each query in a task."""
    rows, n_clauses, n_queries = plan.clauses, len(plan.clauses), len(plan.queries)
    of = lambda o: np.array([r.occur == o for r in rows], bool)
    must, should, bad = of(Q.MUST), of(Q.SHOULD), of(Q.MUST_NOT)
    n_must, n_should = (np.bincount(plan.query[x], minlength=n_queries) for x in (must, should))
    kind = np.array([("term", "phrase").index(r.kind) if r.kind in ("term", "phrase") else 2 for r in rows])
    weight, n_terms = np.array([r.boost for r in rows]), np.array([max(1, len(r.terms)) for r in rows])
    negative = np.flatnonzero((n_must == 0) & (n_should == 0))
    compare = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "": np.equal}
    numbers = [(c, compare[r.op if r.kind == "range" else ""], float(r.value), r.boost if r.kind == "range" else 0.0) for c, r in enumerate(rows) if r.kind == "range" and r.field == "score" or r.kind == "term" and re.fullmatch(r"-?\d+(?:\.\d+)?", r.value)]
    title = plan.fields.index("title") if "title" in plan.fields else -9
    phrases = {c: [(plan.atoms["term", t], o - r.offsets[0]) for t, o in zip(r.terms, r.offsets)] for c, r in enumerate(rows) if r.kind == "phrase"}
    places = {c: [plan.fields.index(r.field)] if r.field else [plan.fields.index(f) for f in ("title", "text", "url") if f in plan.fields] for c, r in enumerate(rows) if r.kind == "phrase"}
    phrase_atoms = np.array(sorted(plan.phrase_atoms), np.int64)
    scope_count = np.append(plan.use_count, 0)

    def stands(c: int, d: int, held: dict) -> bool:
        for f in places[c]:
            at = [held.get((d, f, a)) for a, _ in phrases[c]]
            if all(x is not None for x in at) and any(all(p + o in x for x, (_, o) in zip(at[1:], phrases[c][1:])) for p in at[0]):
                return True
        return False

    def scored(b: pa.RecordBatch, lo: int, hi: int, hits, held: dict):
        """Relevance of all matches of documents lo to hi: (query, document, value)."""
        at, scope, doc, freq, length, in_title, all_len = hits
        use = slice(*np.searchsorted(doc, (lo, hi)))
        doc, scope, w, in_title = doc[use], scope[use], (np.sqrt(freq[use]) / np.sqrt(np.where(plan.any[scope[use]], all_len[doc[use]], length[use]))) * plan.idf[scope[use]] * plan.idf[scope[use]], in_title[use]
        count = plan.use_count[scope]
        clause = plan.use[ranges(plan.use_start[scope], count)]
        key = np.repeat(doc, count) * n_clauses + clause
        part, titled, met = np.repeat(w, count), np.repeat(in_title, count), np.ones(len(key))
        score = [b.column("score").to_numpy(zero_copy_only=False)[lo:hi].astype(float)] if numbers else []
        extra = []
        for c, op, value, worth in numbers:
            d = np.flatnonzero(op(score[0], value)) + lo
            extra.append((d * n_clauses + c, np.full(len(d), worth)))
        n_text = len(key)
        if extra:
            more = np.concatenate([k for k, _ in extra])
            key, part, titled, met = np.r_[key, more], np.r_[part, np.zeros(len(more))], np.r_[titled, np.zeros(len(more), bool)], np.r_[met, np.zeros(len(more))]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.empty(0, np.int64)
        if len(new):
            key_, part, titled, met = key[order][new], np.add.reduceat(part[order], new), np.logical_or.reduceat(titled[order], new), np.add.reduceat(met[order], new)
            c, d = key_ % n_clauses, key_ // n_clauses
            value = np.where(kind[c] == 2, weight[c], part * weight[c] * np.where((kind[c] == 0) & (n_terms[c] > 1), met / n_terms[c], 1.0))
            hit = np.ones(len(c), bool)
            for i in np.flatnonzero(kind[c] == 1):
                hit[i] = met[i] == n_terms[c[i]] and stands(c[i], d[i], held)
            value = np.where(hit, value, 0.0)
            q = plan.query[c]
            group = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(q) != 0)])
            total = lambda x: np.add.reduceat(x.astype(float), group)
            m, s, x = total(must[c] & hit), total(should[c] & hit), total(bad[c] & hit)
            sm, ss = total(np.where(must[c], value, 0.0)), total(np.where(should[c], value, 0.0))
            th = np.logical_or.reduceat(titled & ~bad[c], group)
            q, d = q[group], d[group]
            ok = (m == n_must[q]) & (x == 0) & ((n_must[q] > 0) | (s > 0))
            base = sm + ss * s / np.maximum(n_should[q], 1)
            out = [(q[ok], d[ok], base[ok], th[ok])]
            shut = np.unique(d[x > 0] * n_queries + q[x > 0])
        else:
            out, shut = [], np.empty(0, np.int64)
        if len(negative):
            stored = lo + np.flatnonzero(b.column("stored").to_numpy(zero_copy_only=False)[lo:hi])
            rest = np.setdiff1d((stored[:, None] * n_queries + negative[None, :]).reshape(-1), shut)
            out.append((rest % n_queries, rest // n_queries, np.ones(len(rest)), np.zeros(len(rest), bool)))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def cut(t: pa.Table, least: np.ndarray) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("value", "descending"), ("url", "ascending")])).combine_chunks()
        q = t.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        t = t.filter(pa.array(place < limit))
        full = place == limit - 1
        least[q[full]] = pc.filter(t.column("value"), pa.array(place[place < limit] == limit - 1)).to_numpy()
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, kept, rows_ = np.full(n_queries, -np.inf), [], 0
        for b in batches:
            doc, field, atom, freq, length, where = _opened(b, plan)
            held = {}
            if len(phrase_atoms):
                some = np.flatnonzero(np.isin(atom, phrase_atoms))
                held = dict(zip(zip(doc[some].tolist(), field[some].tolist(), atom[some].tolist()), where.take(pa.array(some)).to_pylist()))
            at, scope = _scoped(doc, field, atom, plan)
            n = max(1, len(plan.scopes))
            key, first, inverse = np.unique(doc[at] * n + scope, return_index=True, return_inverse=True)
            sums = np.bincount(inverse, weights=freq[at], minlength=len(key))
            in_title = np.bincount(inverse, weights=field[at] == title, minlength=len(key)) > 0
            hits = first, key % n, key // n, sums, length[at][first], in_title, pc.fill_null(b.column("all_len"), 1).to_numpy(zero_copy_only=False)
            work = np.bincount(hits[2], weights=scope_count[hits[1]], minlength=b.num_rows) + len(negative) + len(numbers) + 1
            prior = b.column("priority").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(work, PAIRS_AT_ONCE):
                if (found := scored(b, lo, hi, hits, held)) is None:
                    continue
                q, d, base, th = found
                value = rounded(base * (boost * np.where(th, title_factor, 1.0) * np.where(prior[d], priority_factor, 1.0)))
                use = value >= least[q]
                kept.append(pa.table({"q": pa.array(q[use], pa.int64()), "url": b.column("url").take(pa.array(d[use])), "value": pa.array(value[use])}))
                rows_ += int(use.sum())
                if rows_ > HELD:
                    kept = [cut(pa.concat_tables(kept), least)]
                    rows_ = 0
        if kept:
            t = cut(pa.concat_tables(kept), least)
            names = pa.array(plan.queries, pa.int64())
            for x in pa.table({"query_id": names.take(t.column("q").combine_chunks()), "url": t.column("url"), "relevance": t.column("value")}).to_batches(max_chunksize=10_000):
                yield x

    return run
