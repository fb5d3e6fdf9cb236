"""Reading level of documents (p9).

Every word has an acquisition grade: the point of the scale by which half of its use, weighed per graded level,
has occurred. A document's level is predicted from the quantiles of the grades of its known words, calibrated on
the graded sample with word grades that were estimated without the document (cross-fitting).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from mnemora.llm import residue, sitelines
from mnemora.llm.languages import FUNCTION
from mnemora.runtime import cut, map_arrow

#: Bound on the graded documents the model is fitted on.
GRADED_DOCS = 2000
#: Words below this number of graded documents stay unknown; documents with fewer known words get no level.
WORD_DOCS, KNOWN_WORDS = 3, 5
GRADES, FOLDS, RIDGE = 5, 5, 1.0
#: Quantiles of the known words' grades that enter the prediction.
QUANTILES = (0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Grades are kept in steps of this size, so that a document needs only a histogram.
STEPS = 400
#: The level from which a document is demanding, halfway between two grades, and the least number of words.
DEMANDING, MIN_WORDS = 3.5, 40

_WORD = re.compile(r"[^\W_]+")
_APART = {i: " " for i in range(128) if not chr(i).isalnum()}
_LANGUAGES = sorted(FUNCTION)
_OF: dict[str, list[int]] = defaultdict(list)
for _k, _l in enumerate(_LANGUAGES):
    for _w in dict.fromkeys(FUNCTION[_l].split()):
        _OF[_w].append(_k)
_OF_GET = dict(_OF).get
_EN = _LANGUAGES.index("en")


def split_words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    low = text.lower()
    return low.translate(_APART).split() if low.isascii() else _WORD.findall(low)


def is_english(words: list[str]) -> bool:
    """More English function words than of any other language, and not next to none."""
    hits = [0] * len(_LANGUAGES)
    for ks in filter(None, map(_OF_GET, words)):
        for k in ks:
            hits[k] += 1
    en = hits[_EN]
    return en >= 0.08 * len(words) and all(en > h for k, h in enumerate(hits) if k != _EN)


def word_grades(docs: list[tuple[list[str], float]]) -> dict[str, int]:
    """Word -> step of its acquisition grade. Each grade weighs the same, whatever its number of documents."""
    level = [min(GRADES, max(1, round(g))) - 1 for _, g in docs]
    size = np.bincount(level, minlength=GRADES)
    count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(GRADES))
    seen: Counter = Counter()
    for (words, _), k in zip(docs, level):
        for w, n in Counter(words).items():
            count[w][k] += n / len(words)
            seen[w] += 1
    out = {}
    for w, c in count.items():
        if seen[w] < WORD_DOCS or w.isdigit():
            continue
        share = np.where(size > 0, c / np.maximum(size, 1), 0)
        share = np.cumsum(share) / share.sum()
        k = int(np.searchsorted(share, 0.5))
        before = share[k - 1] if k else 0.0
        out[w] = int((k + (0.5 - before) / (share[k] - before)) / GRADES * (STEPS - 1))
    return out


def quantiles(words: list[str], grades: dict[str, int]) -> list[float] | None:
    """Quantiles and mean of the known words' grades, on the scale 0 to 1; None if too few are known."""
    known = sorted([g for g in map(grades.get, words) if g is not None])
    n = len(known)
    if n < KNOWN_WORDS:
        return None
    return [known[int(q * (n - 1))] / STEPS for q in QUANTILES] + [sum(known) / n / STEPS]


class Level:
    def __init__(self, grades: dict[str, int], weights: np.ndarray):
        self.grades, self.weights = grades, [float(w) for w in weights]

    def predict(self, words: list[str]) -> float | None:
        q = quantiles(words, self.grades)
        return None if q is None else min(max(self.weights[0] + sum(map(mul, q, self.weights[1:])), 1.0), float(GRADES))


def fit(docs: list[tuple[int, list[str], float]]) -> Level:
    """From (doc_id, words, grade). Deterministic: folds follow a hash of the id."""
    docs = sorted((d for d in docs if d[1]), key=lambda d: d[0])
    fold = [xxh3_64_intdigest(b"%d" % d[0]) % FOLDS for d in docs]
    grades = word_grades([d[1:] for d in docs]) if docs else {}
    rows, target = [], []
    for f in range(FOLDS):
        part = word_grades([d[1:] for i, d in enumerate(docs) if fold[i] != f]) if len(docs) > 1 else {}
        for i, (_, words, g) in enumerate(docs):
            if fold[i] == f and (q := quantiles(words, part)) is not None:
                rows.append(q)
                target.append(g)
    if len(rows) < 2 * GRADES:
        return Level(grades, np.r_[1.0, np.zeros(len(QUANTILES)), GRADES - 1.0])
    x, y = np.array(rows), np.array(target)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    b = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return Level(grades, np.r_[y.mean() - mean @ b, b])


def _content_words(content, source, text, gone) -> tuple[int, list[str]]:
    """Number of words of the whole text, and the words of its content."""
    kept, dropped = content(source, text, gone)
    words = split_words("\n".join(kept))
    return len(words) + (len(split_words("\n".join(dropped))) if dropped else 0), words


def train(rows: DataFrame, content, labels: DataFrame, limit: int = GRADED_DOCS) -> Level:
    """Fits on English documents of the graded sample, at most ``limit``, those with the lowest hashes of their ids; a document's
    grade is the mean over its reviewers, each counted once. Null grades and repeated rows do not count."""
    graded = labels.where("grade is not null and doc_id is not null").select("doc_id", "reviewer", "grade").distinct()
    graded = graded.groupBy("doc_id").agg(F.avg("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = rows.join(F.broadcast(graded), "doc_id").collect()  # at most ``limit`` documents
    out, seen = [], set()
    for r in sample:
        if r.text and r.doc_id not in seen:
            seen.add(r.doc_id)
            _, words = _content_words(content, r.source, r.text, r.gone)
            if words and is_english(words):
                out.append((r.doc_id, words, float(r.grade)))
    return fit(out)


def _leveled(content, shared):
    """Columns n_words, english and level of a batch of documents."""

    def columns(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        n, en, level = [], [], []
        for source, text, gone in zip(*(b.column(c).to_pylist() for c in ("source", "text", "gone"))):
            total, words = _content_words(content, source, text, gone) if text else (0, [])
            n.append(total)
            en.append(bool(words) and is_english(words))
            level.append(m.predict(words) if en[-1] else None)
        return [pa.array(n, pa.int32()), pa.array(en, pa.bool_()), pa.array(level, pa.float64())]

    return columns


def _prepared(docs: DataFrame, labels: DataFrame, limit: int, columns: list[str]):
    """(rows with doc_id, the given columns and ``gone``; columns of levels): everything but the pass over all texts."""
    often = cut(sitelines.repeated(docs))
    rows, content = sitelines.marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where("doc_id is not null"), often)
    model = train(rows.where("text is not null"), content, labels, limit)
    return rows, _leveled(content, docs.sparkSession.sparkContext.broadcast(model))


_LEVELS = ["n_words", "english", "level"]


def levels(docs: DataFrame, labels: DataFrame, limit: int = GRADED_DOCS) -> DataFrame:
    """p9_levels: (doc_id, n_words, english, level) of every document with text: number of words, whether its content
    is English, and its level from 1 to GRADES (null if not English or with too few known words).

    Site lines do not count as content. Documents with a null text or doc_id have no row; empty texts have a null
    level. Further columns of either table are ignored, and either may be empty."""
    rows, columns = _prepared(docs, labels, limit, ["source", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns(b)], ["doc_id", *_LEVELS])

    return map_arrow(rows.where("text is not null").select("doc_id", "source", "text", "gone"), run, "doc_id long, n_words int, english boolean, level double")


def found(docs: DataFrame, labels: DataFrame, limit: int = GRADED_DOCS) -> DataFrame:
    """p9_found: doc_id of English documents of at least MIN_WORDS words whose content is at level 4 or 5, cases of
    p1_found excepted. One pass over the texts gives the levels and what p1_found is induced from. See ``levels`` for
    nulls and empty tables."""
    rows, columns = _prepared(docs, labels, limit, ["title", "text", "source", "url"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                arrays, names = residue.scanned(b)
                yield pa.RecordBatch.from_arrays([*arrays, *columns(b)], [*names, *_LEVELS])

    base = cut(map_arrow(rows, run, residue.BASE + ", n_words int, english boolean, level double"))
    hard = base.where((F.col("n_words") >= MIN_WORDS) & (F.col("level") >= DEMANDING)).select("doc_id")
    return hard.distinct().join(residue.cases(base), "doc_id", "left_anti")
