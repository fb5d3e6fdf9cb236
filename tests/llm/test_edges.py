"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemora.llm import bpe, dedupe, mainbody, mixing, neardup, readlevel, residue, sitelines, topn

T0 = dt.datetime(2024, 1, 1)
DOCS = "doc_id long, url string, title string, text string, lang string, source string, collection string, n_chars long, captured_at timestamp"
CAPTURES = "page_id long, url string, title string, text string, html string, captured_at timestamp"
LABELS = "doc_id long, reviewer string, grade int"
TARGETS = "collection string, target_share double, max_repeats int"
CLASH = ["a", "b", "c", "d", "p", "n", "k1", "k2", "rep", "kind", "dest", "node", "gone", "shape", "flag", "key", "head", "extra", "copies", "level", "words", "line_no", "count", "__salt", "g", "s", "i"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def docs_table(spark, rows):
    return spark.createDataFrame([(i, u, t, x, "en", s, c, None, T0) for i, u, t, x, s, c in rows], DOCS)


def clash(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c.lower() not in have])


ODD = [(1, None, None, None, None, None), (2, "", "", "", "", ""), (3, "u", " ", " \n\t\n ", "s", "c"), (4, "u", "t", LONG, "s", "c"), (5, "u", "t", LONG, "s", "c"), (6, "u", "t", "a" * 300_000, "s", "c"), (7, "u", "t", "😀́ \x00 x\r\ny", "s", "c"), (None, "u", "t", "text", "s", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return clash(docs_table(spark, ODD + [ODD[3], ODD[1]][:0]))


@pytest.fixture(scope="module")
def none(spark):
    return docs_table(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def targets(spark, rows=()):
    return spark.createDataFrame(list(rows), TARGETS)


RUNS = {
    "residue": lambda s, d: residue.found(d),
    "neardup": lambda s, d: neardup.found(d),
    "classes": lambda s, d: neardup.classes(d),
    "sitelines": lambda s, d: sitelines.found(d),
    "clean": lambda s, d: sitelines.clean(d),
    "ids": lambda s, d: bpe.ids(d),
    "selection": lambda s, d: mixing.selection(d, targets(s, [("c", 0.5, 2), ("none", 0.5, 1), (None, 0.1, 1), ("c", 0.2, 1)])),
    "shares": lambda s, d: mixing.shares(d, targets(s, [("c", 0.5, 2), ("none", None, None)])),
    "levels": lambda s, d: readlevel.levels(d, labels(s, [(4, "r", 3), (4, "r", 3), (5, "r", None), (None, None, None)])),
    "hard": lambda s, d: readlevel.found(d, labels(s)),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_documents(spark, odd, name):
    rows = RUNS[name](spark, odd).collect()
    got = {r[0] for r in rows if r[0] is not None}
    if name == "neardup":
        assert [(r.doc_id_a, r.doc_id_b) for r in rows] == [(4, 5)]
    elif name == "classes":
        assert {(r.doc_id, r.class_id, r.n_links) for r in rows} == {(i, 4 if i == 5 else i, 0) for i in range(1, 8)}
    elif name == "ids":
        assert len(rows) == 8 and all(r.ids == [] for r in rows if r.doc_id in (1, 2)) and len([r for r in rows if r.doc_id == 6][0].ids) > 0
    elif name == "clean":
        assert len(rows) == 8
    elif name == "selection":
        assert got <= {3, 4, 5, 6, 7} and all(r.copies in (1, 2) for r in rows)
    elif name == "shares":
        assert {r.collection: round(r.share, 6) for r in rows} == {"c": 1.0, "none": 0.0}
    elif name == "levels":
        assert got == {2, 3, 4, 5, 6, 7}
    else:
        assert got <= {4, 5, 6, 7}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, none, name):
    rows = RUNS[name](spark, none).collect()
    assert len(rows) == (2 if name == "shares" else 0)


def test_captures_edges(spark):
    body = "Menu\nBig title\n" + "A long paragraph with many words that goes on and on until it is done. " * 3 + "\nCopyright"
    page = "<body><nav><a>Menu</a></nav><article><h1>Big title</h1><p>" + body.split("\n")[2] + "</p></article><footer>Copyright</footer></body>"
    rows = [(1, "http://a.example/x", "Big title", body, page, T0)] * 3 + [(2, None, None, None, None, T0), (3, "", "", "", "", T0), (4, None, None, "\n \nx", None, T0), (None, "u", "t", "x", None, T0), (5, "u", "t", body, "<p>unrelated</p><", T0), (6, "u", "t", LONG, "<div " * 1000, T0)]
    got = mainbody.found(clash(spark.createDataFrame(rows, CAPTURES))).collect()
    assert [r.line_no for r in sorted(got, key=lambda r: r.line_no) if r.page_id == 1] == [1, 2]
    assert not {r.page_id for r in got} & {2, 3, None}
    assert len(got) == len(set(got))
    assert mainbody.found(spark.createDataFrame([], CAPTURES)).count() == 0


def test_top_edges(spark):
    rows = [(1, 5, 1), (1, 5, 1), (1, 5, 0), (1, None, 9), (None, 5, 2), (2, 0, 7), (2, -1, 8), (1, 4, 3), (1, 6, 4)]
    df = clash(spark.createDataFrame(rows, "history_id long, `count` long, link_id long"))
    got = [tuple(r) for r in topn.top_n(df, "history_id", "count", "link_id", 3).orderBy("history_id", F.desc("count"), "link_id").collect()]
    assert got == [(1, 6, 4), (1, 5, 0), (1, 5, 1), (2, 0, 7), (2, -1, 8)]
    assert topn.top_n(df, "history_id", "count", "link_id", 0).count() == 0
    assert topn.top_n(df.limit(0), "history_id", "count", "link_id", 3).count() == 0


def test_hidden_duplicates_edges(spark):
    links = clash(spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "u"), (5, "u"), (5, "u"), (6, "U"), (7, LONG), (8, LONG.upper())], "id long, url string"))
    hist = clash(spark.createDataFrame([(1, None), (2, ""), (3, "-"), (4, "u")], "id long, query string"))
    got = {tuple(r) for r in dedupe.found(links, hist, 3).collect()}
    assert got == {("links", 2, 3), ("links", 5, 6), ("links", 7, 8), ("histories", 2, 3)}
    assert {tuple(r) for r in dedupe.counts(links, hist, 3).collect()} == {("links", 2, 2), ("links", 5, 2), ("links", 7, 2), ("histories", 2, 2), ("histories", 4, 1)}
    assert dedupe.found(links.limit(0), hist.limit(0)).count() == 0
