"""Main body of web pages (p4): a linear-chain conditional random field over the lines of a page.

Every line of a page's text is tied to its leaf block in the HTML by walking both in order; ancestor tags, the
block around it and the text itself give its features. The field has two labels, its weights are learned from
pages whose markup names its parts (a main element or a content block, and boxes inside it), a bounded sample,
and every page is decoded by Viterbi. Each training page is used three times: as it is, without the names, and
without HTML, so that pages of anonymous markup and pages without HTML are decoded by what is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from mnemora.runtime import map_arrow

#: Bounds on the labelled pages the field is fitted on, and on the length of one of them in lines and in characters of
#: HTML.
TRAIN_PAGES, TRAIN_LINES, TRAIN_CHARS = 1200, 400, 200_000
#: Size of the hashed feature space, passes and strength of regularisation.
FEATURES, PASSES, RATE, L2 = 1 << 18, 120, 0.08, 2e-4

# Names by which pages mark their main part.
BODY_TAGS = frozenset({"main", "article"})
BODY_NAMES = frozenset({"content", "post", "body", "article", "entry", "main", "story"})
_VOID = frozenset({"br", "link", "img", "meta", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"})
_HIDDEN = frozenset({"script", "style", "head", "noscript", "template", "title"})
_INLINE = frozenset({"a", "span", "b", "i", "em", "strong", "code", "u", "small", "sub", "sup", "mark", "abbr", "time"})
_SEMANTIC = frozenset({"main", "article", "aside", "nav", "footer", "header", "section"})
_BLOCK_TEXT = frozenset({"p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure", "figcaption", "blockquote", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th"})

_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:]*)([^<>]*)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"""\b(?:id|class)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")


class Leaf:
    """Path of a stretch of text: tags from the outside in, the names on them, and the outermost block."""

    __slots__ = ("tags", "names", "top", "link", "label")

    def __init__(self, stack: list[tuple[str, tuple[str, ...], int]]):
        self.tags = tuple(t for t, _, _ in stack)
        self.names = tuple(n for _, ns, _ in stack for n in ns)
        self.top = next((k for t, _, k in stack if t not in ("html", "body", "main", "table", "tbody", "tr")), -1)
        self.link = "a" in self.tags
        self.label = _label(stack)


def _label(stack) -> int:
    """1: body, 0: other part of a page with a named body; -1: the path says nothing by itself."""
    at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BODY_TAGS or BODY_NAMES.issuperset(stack[i][1]) and stack[i][1]), None)
    if at is None:
        return -1
    return int(all(t in _BLOCK_TEXT or t in _INLINE and not ns for t, ns, _ in stack[at + 1 :]))


def flatten(html: str) -> tuple[str, list[int], list[Leaf]]:
    """All visible characters but white space, and the leaf from each offset on."""
    stack: list[tuple[str, tuple[str, ...], int]] = []
    text, offsets, leaves, size, hidden, made = [], [], [], 0, 0, 0
    leaf = None
    for m in _TOKEN.finditer(html):
        close, tag, attrs, data = m.groups()
        if data is not None:
            if hidden:
                continue
            s = _SPACE.sub("", unescape(data) if "&" in data else data)
            if s:
                if leaf is None:
                    leaf = Leaf(stack)
                offsets.append(size)
                leaves.append(leaf)
                text.append(s)
                size += len(s)
        elif tag:
            tag = tag.lower()
            if close:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if k is not None:
                    hidden -= sum(t in _HIDDEN for t, _, _ in stack[k:])
                    del stack[k:]
                    leaf = None
            elif tag not in _VOID and not attrs.endswith("/"):
                names = tuple(x for a in _ATTR.findall(attrs) for x in re.split(r"[\s_\-]+", (a[0] or a[1] or a[2]).lower()) if x) if attrs else ()
                made += 1
                stack.append((tag, names, made))
                hidden += tag in _HIDDEN
                leaf = None
    return "".join(text), offsets, leaves


def align(lines: list[str], html: str | None) -> list[Leaf | None]:
    """The leaf at which each line begins; None where a line isn't found in its order."""
    if not html:
        return [None] * len(lines)
    stream, offsets, leaves = flatten(html)
    out, pos, at = [], 0, 0
    for line in lines:
        s = _SPACE.sub("", line)
        if not stream.startswith(s, pos):
            k = stream.find(s, pos)
            if k < 0:
                out.append(None)
                continue
            pos = k
        while at + 1 < len(offsets) and offsets[at + 1] <= pos:
            at += 1
        out.append(leaves[at] if leaves else None)
        pos += len(s)
    return out


def _bucket(n: int) -> int:
    return n if n < 4 else 2 + n.bit_length()


class _Memo(dict):
    """Hashed features by their names; emptied when it holds MOST of them."""

    MOST = 1 << 18

    def __missing__(self, s: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[s] = h = xxh3_64_intdigest(s) % FEATURES
        return h


_hash = _Memo().__getitem__


def features(title: str | None, url: str | None, lines: list[str], leaves: list[Leaf | None]) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Hashed features of each line in three groups: from the text, from the tags, from the names in the markup."""
    n = len(lines)
    norm = [" ".join(x.split()).lower() for x in lines]
    heading = " ".join((title or "").split()).lower()
    host = re.split(r"[/?]", (url or "").partition("://")[2].lower(), maxsplit=1)[0]
    site = [x for x in re.split(r"[.\-]", host) if len(x) >= 4 and x not in ("docs", "blog", "test", "example", "invalid")]
    head = next((i for i, x in enumerate(norm) if heading and x == heading), None)
    words = [_WORD.findall(x) for x in norm]
    shapes = []
    for x in norm:
        for s in site:
            x = x.replace(s, "@")
        shapes.append(_NUMBER.sub("#", x))
    long = [len(w) >= 12 or len(x) >= 60 for w, x in zip(words, norm)]
    first_long = next((i for i in range(n) if long[i]), n)
    last_long = next((i for i in range(n - 1, -1, -1) if long[i]), -1)
    # per outermost block its lines, the place of each line among them and the number of long ones; the same per path
    tops: dict[int, list[int]] = {}
    place, long_of, same, long_same = [0] * n, Counter(), Counter(), Counter()
    for i, f in enumerate(leaves):
        if f is not None:
            place[i] = len(tops.setdefault(f.top, []))
            tops[f.top].append(i)
            long_of[f.top] += long[i]
            path = f.tags, f.names
            same[path] += 1
            long_same[path] += long[i]
    short = [f"{_bucket(len(w))}{'.' if x[-1] in '.!?。' else ':' if x[-1] == ':' else '-'}" for w, x in zip(words, norm)]
    text, tags, names = [], [], []
    for i in range(n):
        x, w, s = norm[i], words[i], shapes[i]
        t = ["b", "s" + s if len(s) < 120 else "sl", "l" + short[i], f"c{_bucket(len(x))}", f"i{min(i, 6)}", f"e{min(n - 1 - i, 6)}"]
        t += ["w" + y for y in set(w)]
        if len(w) <= 8:
            t += [f"{a}_{b}" for a, b in zip(w, w[1:])]
        t.append(f"h{0 if head is None else 1 if i < head else 2 if i == head else 3}{min(abs(i - head), 3) if head is not None else ''}")
        t.append(f"r{int(i < first_long)}{int(i > last_long)}")
        t.append(f"f{min(first_long - i, 4) if i < first_long else 'm' if i <= last_long else min(i - last_long, 5)}")
        for c in "|·>©:":
            if c in x:
                t.append("has" + c)
        t.append(f"d{_bucket(sum(map(str.isdigit, x)))}")
        t.append(f"u{int(lines[i].strip()[:1].isupper())}")
        for k in (-3, -2, -1, 1, 2, 3):
            j = i + k
            if 0 <= j < n:
                t.append(f"n{k}{short[j]}")
                if len(words[j]) <= 7:
                    t.append(f"m{k}{shapes[j]}")
                    if abs(k) == 1:
                        t += [f"v{k}{y}" for y in words[j]]
            else:
                t.append(f"n{k}out")
        # the run of short lines around the line, and the line before it
        a = i
        while a > 0 and not long[a - 1] and i - a < 12 and not long[i]:
            a -= 1
        t.append(f"q{_bucket(i - a)}")
        text.append(list(map(_hash, t)))
        f = leaves[i]
        if f is None:
            tags.append([_hash("nohtml")])
            names.append([_hash("nonames")])
            continue
        plain = [y for y in f.tags if y not in _SEMANTIC and y not in ("html", "body")]
        around = tops[f.top]
        g = [f"T{plain[-1] if plain else ''}", "P" + ">".join(plain[-3:]), f"D{len(plain)}", f"L{int(f.link)}", f"T{plain[-1] if plain else ''}{short[i]}"]
        g += [f"G{_bucket(len(around))}", f"GH{int(head is not None and leaves[head] is not None and leaves[head].top == f.top)}", f"GL{_bucket(long_of[f.top])}", f"GI{min(place[i], 4)}", f"GE{min(len(around) - 1 - place[i], 4)}"]
        g.append("GF" + shapes[around[0]] if len(words[around[0]]) <= 7 else "GF-")
        for k in (-1, 1):
            j = i + k
            o = leaves[j] if 0 <= j < n else None
            g.append(f"N{k}{(o.tags[-1] if o.tags else '') if o is not None else None}{int(o is not None and o.top == f.top)}{int(o is not None and o.tags == f.tags and o.names == f.names)}")
        path = f.tags, f.names
        g.append(f"S{_bucket(same[path])}{_bucket(long_same[path])}")
        tags.append(list(map(_hash, g)))
        names.append([_hash(y) for y in {*("A" + y for y in f.tags if y in _SEMANTIC), *("C" + y for y in f.names), f"Y{f.label}"}])
    return text, tags, names


class Field:
    """Weights: one per feature (for the body label) and a 2 x 2 matrix of transitions, with start and end."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, ends: np.ndarray):
        self.w, self.trans, self.ends = w, trans, ends

    def decode(self, lines: list[list[int]]) -> np.ndarray:
        """Viterbi: the best labels of one page."""
        if not lines:
            return np.zeros(0, bool)
        starts = np.cumsum([0, *map(len, lines[:-1])])
        s = np.add.reduceat(self.w[np.fromiter(chain.from_iterable(lines), np.int64)], starts).tolist()  # every line has features
        (a00, a01), (a10, a11) = self.trans.tolist()
        v0, v1 = float(self.ends[0, 0]), float(self.ends[0, 1]) + s[0]
        back = []
        for x in s[1:]:
            p0, p1 = v1 + a10 > v0 + a00, v1 + a11 > v0 + a01
            v0, v1 = (v1 + a10 if p0 else v0 + a00), (v1 + a11 if p1 else v0 + a01) + x
            back.append((p0, p1))
        y = int(v1 + self.ends[1, 1] > v0 + self.ends[1, 0])
        out = [y]
        for p in reversed(back):
            y = int(p[y])
            out.append(y)
        return np.array(out[::-1], bool)


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Maximum likelihood with L2, by Adam over all pages at once; forward and backward run over all pages in
    step. Deterministic."""
    w, trans, ends = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros((2, 2))
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    if not pages:
        return Field(w, trans, ends)
    size = np.array([len(p[0]) for p in pages])
    n, t = len(pages), int(size.max())
    flat = np.array([i for p in pages for line in p[0] for i in line], np.int64)
    starts = np.cumsum([0, *(len(line) for p in pages for line in p[0])])
    per = np.diff(starts)
    page, step = np.repeat(np.arange(n), size), np.concatenate([np.arange(s) for s in size])
    gold = np.zeros((n, t), int)
    gold[page, step] = np.concatenate([p[1] for p in pages])
    alive = np.arange(t)[None] < size[:, None]
    live = alive.sum(0).tolist()  # pages that reach a step come first
    count = np.bincount(flat, minlength=FEATURES)
    rare = count < 3
    params = [w, trans, ends]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, PASSES + 1):
        score = np.zeros((n, t, 2))
        score[page, step, 1] = np.add.reduceat(w[flat], starts[:-1])
        alpha = np.zeros((n, t, 2))
        alpha[:, 0] = score[:, 0] + ends[0]
        for i in range(1, t):
            m = live[i]
            alpha[:m, i] = np.logaddexp(alpha[:m, i - 1, :1] + trans[0], alpha[:m, i - 1, 1:] + trans[1]) + score[:m, i]
        beta = np.zeros((n, t, 2))
        last = np.arange(n), size - 1
        beta[last] = ends[1]
        for i in range(t - 2, -1, -1):
            m = live[i + 1]
            x = beta[:m, i + 1] + score[:m, i + 1]
            beta[:m, i] = np.logaddexp(trans[:, 0] + x[:, :1], trans[:, 1] + x[:, 1:])
        z = np.logaddexp.reduce(alpha[last] + ends[1], axis=1)
        marg = np.exp(alpha + beta - z[:, None, None]) * alive[..., None]
        g_line = (gold - marg[..., 1])[page, step]
        gw = np.bincount(flat, weights=np.repeat(g_line, per), minlength=FEATURES) / n
        gw -= L2 * w
        gw[rare] = 0
        gt, ge = np.zeros((2, 2)), np.zeros((2, 2))
        both = alive[:, 1:]
        pair = alpha[:, :-1, :, None] + trans + (score + beta)[:, 1:, None, :] - z[:, None, None, None]
        gt -= (np.exp(np.where(both[..., None, None], pair, -np.inf))).sum((0, 1))
        np.add.at(gt, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        ge[0] -= marg[:, 0].sum(0)
        ge[1] -= marg[last].sum(0)
        np.add.at(ge[0], gold[:, 0], 1)
        np.add.at(ge[1], gold[last], 1)
        for p, g, m1, m2 in zip(params, (gw, gt / n, ge / n), mean, var):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Field(w.astype(np.float32), trans, ends)


def page_lines(text: str | None) -> tuple[list[int], list[str]]:
    raw = (text or "").split("\n")
    at = [i for i, x in enumerate(raw) if x.strip()]
    return at, [raw[i] for i in at]


def examples(title, url, text, html) -> list[tuple[list[list[int]], list[int]]]:
    """A labelled page in three forms, or nothing if its markup doesn't name its body."""
    _, lines = page_lines(text)
    if not html or not lines or len(lines) > TRAIN_LINES:
        return []
    leaves = align(lines, html)
    if not any(f is not None and f.label == 1 for f in leaves) or sum(f is None for f in leaves) > 0.1 * len(lines):
        return []
    y = [int(f is not None and f.label == 1) for f in leaves]
    a, b, c = features(title, url, lines, leaves)
    bare = features(title, url, lines, [None] * len(lines))
    none = _hash("nonames")
    return [([p + q + r for p, q, r in zip(a, b, c)], y), ([[*p, *q, none] for p, q in zip(a, b)], y), ([p + q + r for p, q, r in zip(*bare)], y)]


def train(captures: DataFrame, pages: int = TRAIN_PAGES) -> Field:
    """Fits the field on at most ``pages`` labelled pages, those with the lowest hash of their id."""
    rows = captures.select("page_id", "title", "url", "text", "html").where("html is not null and text is not null and text <> ''")
    named = rows.where(F.length("html") <= TRAIN_CHARS).where(F.lower("html").rlike(r"<(main|article)\b|(id|class)\s*=\s*[\"'][^\"']*\b(content|post|article|entry|story)\b"))
    sample = named.orderBy(F.xxhash64("page_id"), "page_id").limit(pages).collect()
    seen, out = set(), []
    for r in sample:
        if r.page_id not in seen:
            seen.add(r.page_id)
            out += examples(r.title, r.url, r.text, r.html)
    return fit(out)


def decode(field: Field, title, url, text, html) -> list[int]:
    """Numbers of the body lines of one page."""
    at, lines = page_lines(text)
    if not lines:
        return []
    groups = features(title, url, lines, align(lines, html))
    best = field.decode([a + b + c for a, b, c in zip(*groups)])
    return [i for i, y in zip(at, best) if y]


def found(captures: DataFrame, pages: int = TRAIN_PAGES) -> DataFrame:
    """p4_found: (page_id, line_no) of the lines of the main body.

    A null or empty text has no lines; null or empty html, title and url are allowed. Repeated rows count once, a
    null page_id gives no row. Line numbers count the pieces of ``text`` split at line feeds, empty ones included.
    Rows that differ under one page_id give the lines of
    either. An empty table gives no rows; further columns are ignored. The model sent to the executors has a fixed size."""
    model = train(captures, pages)
    shared = captures.sparkSession.sparkContext.broadcast((model.w, model.trans, model.ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for b in batches:
            lines = [decode(field, *page) for page in zip(*(b.column(c).to_pylist() for c in ("title", "url", "text", "html")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(lines, pa.list_(pa.int32()))], ["page_id", "lines"])

    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), "title", "url", "text", "html").where("page_id is not null and text is not null")
    pages_ = map_arrow(rows, run, "page_id long, lines array<int>").where(F.size("lines") > 0)
    once = pages_.groupBy("page_id").agg(F.collect_set("lines").alias("lines"))  # equal rows collapse before the shuffle
    return once.select("page_id", F.explode(F.array_distinct(F.flatten("lines"))).alias("line_no"))
