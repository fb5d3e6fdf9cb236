import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemora import rules as R
from mnemora import sources
from mnemora.archive import Archive
from mnemora.functions import html as H
from mnemora.functions import text as X
from mnemora.functions import urls as U
from mnemora.operators import documents as D
from mnemora.operators import history as HI
from mnemora.operators import search as S

T0 = dt.datetime(2024, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("url,ok", [("", False), ("nope", False), ("http://", False), ("http://a_b.com/x", True), ("http://x/a b", True), ("HTTP://UP.example", True), (None, False), ("mailto:a@b", False)])
def test_valid(spark, url, ok):
    assert one(spark, U.is_valid(F.lit(url).cast("string"))) is ok


def test_urls(spark):
    assert one(spark, U.host(F.lit("https://h:8080/p?q#f"))) == "h:8080"
    assert one(spark, U.strip_fragment(F.lit("https://h/p#f"))) == "https://h/p"
    assert one(spark, U.strip_fragment(F.lit("https://h/p#"))) == "https://h/p#"
    assert one(spark, U.websocket(F.lit("http://h:1/x"))) == "ws://h:1/search"
    assert one(spark, U.base_url(F.lit(None).cast("string"), F.lit("a:1"))) == "http://a:1"
    assert one(spark, U.search_engine("s?q={query}&r={query}", F.lit("a b*~"))) == "s?q=a%20b%2A~&r={query}"
    assert one(spark, U.query_of(F.lit("http://x/?a=1&q=b%20c"))) == "b c"
    assert one(spark, U.has_base(F.lit("http://h/x"), "http://h")) is True
    assert one(spark, U.has_base(F.lit("http://hx/x"), "http://h")) is False


@pytest.mark.parametrize(
    "html,url,icon",
    [
        ("", "https://a.example/x/y?z", "https://a.example/favicon.ico"),
        ('<link rel="icon" href="/img/a.png">', "https://a.example/x/y", "https://a.example/img/a.png"),
        ("<link rel='shortcut icon' href='fav.ico'>", "https://a.example/x/y?q=/z", "https://a.example/x/fav.ico"),
        ('<link rel="icon" href="fav.ico">', "https://a.example", "https://a.example/fav.ico"),
        ('<link rel="stylesheet" href="s.css"><link rel="icon" href="//cdn.example/i.png">', "https://a.example/", "https://cdn.example/i.png"),
        ('<link rel="icon" href="https://b.example/i.png">', "https://a.example/", "https://b.example/i.png"),
        ('<link rel="lexicon" href="no.png">', "https://a.example/", "https://a.example/favicon.ico"),
    ],
)
def test_favicon(spark, html, url, icon):
    assert one(spark, H.favicon_url(F.lit(html), F.lit(url))) == icon


def test_html(spark):
    page = F.lit("<head><title lang='x'> A &amp; B </title><style>s</style></head><body><p>One&nbsp;<b>two</b></p><script>no()</script><!-- no -->three</body>")
    assert one(spark, H.title(page)) == "A & B"
    assert one(spark, H.text(page)) == "One two three"
    assert one(spark, H.data_url(F.lit("image/png"), F.lit(b"a"))) == "data:image/png;base64,YQ=="


def test_text(spark):
    assert one(spark, X.truncate(F.lit("abcdef"), 3)) == "abc[..]"
    assert one(spark, X.truncate(F.lit("abc"), 3)) == "abc"
    assert one(spark, X.tokens(F.lit("Can't stop 3.14, e_x!"))) == ["can't", "stop", "3.14", "e_x"]
    assert one(spark, X.terms(F.lit("The cat and dog"))) == ["cat", "dog"]
    assert one(spark, X.fields(F.lit("  a  b "))) == ["a", "b"]
    assert one(spark, X.fallback(F.lit(""), "-")) == "-"


def test_rules(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    r = R.Rules.load(spark, path)
    assert r == R.Rules() == R.Rules.load(spark, path)
    assert one(spark, r.is_skipped(F.lit("http://x"))) is False  # no pattern matches nothing
    r = r.with_patterns("a+  ^b", "c").with_alias("k", "v w").with_alias("", "x")
    r.save(spark, path)
    assert R.Rules.load(spark, path) == r and r.skip == ("a+", "^b") and r.aliases == {"k": "v w"}
    with pytest.raises(Exception):
        r.with_patterns("(", "")
    assert R.Rules.load(spark, path) == r
    with pytest.raises(KeyError):
        r.without_alias("none")
    assert one(spark, R.matches(F.lit("x"), ("(",))) is False
    assert one(spark, r.is_priority(F.lit("http://C/"))) is True


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "url string, v int")
    once = D.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in D.upsert(once, new).collect()} == {tuple(r) for r in once.collect()}


def test_changes(spark):
    v = spark.createDataFrame([("u", 1, "a", False), ("u", 2, "a", False), ("u", 3, None, False), ("u", 4, None, True), ("u", 5, "a", False), ("w", 1, None, False)], "url string, at int, html string, f boolean")
    assert {(r.url, r["at"]) for r in D.changed(v, "url", "html", "at").collect()} == {("u", 1), ("u", 3), ("u", 5), ("w", 1)}
    assert {(r.url, r["at"]) for r in D.changed(v, "url", "html", "at", force="f").collect()} == {("u", 1), ("u", 3), ("u", 4), ("u", 5), ("w", 1)}


def test_history(spark):
    rows = [(1, T0, T0, "u1", "first", "q"), (1, T0, T0 + dt.timedelta(1), "u1", "again", "q"), (2, T0 + dt.timedelta(1), T0, "u1", "second", "q"), (3, T0, T0, "u2", None, "q"), (4, T0, T0, None, "x", "q"), (5, T0, T0, "u2", "x", None), (6, T0, T0, "u2", "t", "r")]
    c = HI.deduplicated(spark.createDataFrame(rows, "click_id long, ts timestamp, received_at timestamp, url string, title string, query string"))
    assert {tuple(r) for r in HI.counts(c).select("query", "url", "count").collect()} == {("q", "u1", 2), ("q", "u2", 1), ("r", "u2", 1)}
    assert {r.url: r.title for r in HI.links(c).collect()} == {"u1": "first", "u2": None}
    assert [(r.query, r.rank, r.url) for r in HI.top_by_query(HI.counts(c), HI.links(c), 1).orderBy("query").collect()] == [("q", 1, "u1"), ("r", 1, "u2")]
    assert HI.counts(c).agg(F.sum("count")).first()[0] == c.count()
    stored = spark.createDataFrame([("u1", "kept")], "url string, title string")
    assert {tuple(r) for r in HI.merge_links(stored, HI.links(c)).collect()} == {("u1", "kept"), ("u2", None)}


def test_config(tmp_path):
    c = sources.Config.parse("app:\n  search_url: 'https://s/?q={query}'\nserver:\n  base_url: http://h:1/x/  # note\n")
    assert c.base_url == "http://h:1/x" and c.search_url == "https://s/?q={query}"
    assert sources.Config().checked().base_url == "http://127.0.0.1:4433"
    with pytest.raises(ValueError):
        sources.Config(base_url="nope").checked()
    c.write(str(tmp_path / "c.yml"))
    with pytest.raises(FileExistsError):
        c.write(str(tmp_path / "c.yml"))
    assert sources.Config.load(str(tmp_path / "c.yml")) == c
    assert c.full_path("/x") == "/x" and c.full_path("~x").endswith("/.config/mnemora/~x") and c.full_path("./x").endswith("/x")
    c = sources.Config.parse("app:\n  directory: '/a #1'  # note\n  log_level: debug#1\nother:\n  directory: /wrong\n  deeper:\n    address: no\nserver:\n  address: h:2\n")
    assert (c.directory, c.log_level, c.address, c.base_url) == ("/a #1", "debug#1", "h:2", "http://h:2")
    with pytest.raises(ValueError):
        sources.Config.parse("- a list")


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"url":"http://x/","title":"t","text":"b","faviconURL":"dropped"}\n')
    r = sources.documents_json(spark, str(tmp_path / "d.json")).first()
    assert r.url == "http://x/" and r.html is None and "faviconURL" not in r
    m = spark.createDataFrame([('{"url":"u"}',), ("broken",), ("null",)], "value string")
    assert [x.url for x in sources.documents_from_messages(m).collect()] == ["u"]
    f = sources.documents_from_form(spark.createDataFrame([("u", "t", "x")], "url string, title string, text string")).first()
    assert (f.html, f.favicon) == ("", "")


def test_archive(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "archive"))
    a.set_patterns("secret", "")
    page = [("http://x.example/a#f", "Red fox", "a fox runs"), ("http://x.example/secret", "no", "fox"), ("http://127.0.0.1:4433/", "own", "fox"), ("bad", "b", "fox")]
    assert a.add(spark.createDataFrame(page, "url string, title string, text string")) == 1
    assert a.add(spark.createDataFrame([("http://x.example/a", "Red fox", "a fox sleeps")], "url string, title string, text string")) == 1
    assert Path(tmp_path / "archive" / "documents").exists()
    a.compact()
    assert a.versions().count() == 1 and not Path(tmp_path / "archive" / "documents").exists()
    a.refresh()
    assert [r.url for r in a.list_urls().collect()] == ["http://x.example/a"]
    assert a.search("fox sleeps").first().text == "a <mark>fox</mark> <mark>sleeps</mark>"
    assert a.total("fox") == 1 and a.total("runs") == 0
    a.add_alias("f", "fox")
    a.record_clicks(spark.createDataFrame([("http://x.example/a", "t1", "f"), ("http://x.example/a", "t2", "f")], "url string, title string, query string"))
    r = a.history_for("f").first()
    assert (r.url, r["count"]) == ("http://x.example/a", 2) and a.history_for("fox").count() == 1
    told = json.loads(a.answer('{"text": "f", "highlight": "HTML"}'))
    assert told["total"] == 1 and told["query"]["text"] == "fox" and told["documents"][0]["title"] == "Red <mark>fox</mark>" and told["history"][0]["count"] == 2
    assert a.answer("null") is None and a.answer("{") is None and json.loads(a.answer("{}"))["documents"] == []
    a.delete_alias("f")
    assert Archive(spark, str(tmp_path / "archive")).rules == a.rules


def test_archive_is_up_to_date_and_counts_clicks_once(spark, tmp_path):
    folder = f"file:{tmp_path}/archive"
    a = Archive(spark, folder)
    page = lambda *rows: spark.createDataFrame(list(rows), "url string, title string, text string, score double")
    u = "http://x.example/"
    a.add(page((u + "a", "A", "fox", 5.0), (u + "b", "B", "fox and hen", None), (u + "c", "C", "hen", 1.0)))
    a.refresh()
    assert {r.url for r in a.search("fox").collect()} == {u + "a", u + "b"} and a.statistics("fox", S.Options()).frequency[("*", "fox")] == 2
    full = {r.url: r.relevance for r in S.results(a.postings(), a.documents(), "fox", S.Options()).collect()}
    assert {r.url: r.relevance for r in a.search("fox").collect()} == full
    a.add(page((u + "b", "B", "hen alone", None), (u + "d", "D", "fox again", None)))
    assert {r.url for r in a.search("fox").collect()} == {u + "a", u + "d"} and a.total("fox") == 2 and a.total("hen") == 2
    assert {r.url for r in a.search("score:>2").collect()} == {u + "a"}
    before = {r.url: r.relevance for r in a.search("fox").collect()}
    a.refresh()
    assert {r.url: r.relevance for r in a.search("fox").collect()} == before
    plan = a.documents().where(F.col("url").isin([u + "a"])).select("url", "text")._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [IsNotNull(url), EqualTo(url,{u}a)]" in plan
    click = spark.createDataFrame([(u + "a", "t", "q", "k1"), (u + "a", "t", "q", "k2")], "url string, title string, query string, click_id string")
    a.record_clicks(click)
    a.record_clicks(click)
    assert a.history_for("q").first()["count"] == 2
    told = json.loads(a.answer('{"text": "/[/", "fields": 3}'))
    assert told["total"] == 0 and told["documents"] == [] and "error" in told
    assert len(list(a.answer_typed(["f", "fo", "fo", "fox"]))) == 3
    assert json.loads(a.answer('{"text": "fox", "fields": ["url"]}'))["documents"][0]["title"] == ""
    got = {(r.query_id, r.url) for r in a.search_all(spark.createDataFrame([(1, "fox"), (2, "hen -alone")], "query_id long, text string")).collect()}
    assert got == {(1, u + "a"), (1, u + "d"), (2, u + "c")}


def test_look_up_or_add(spark):
    stored = spark.createDataFrame([(3, "a"), (7, "b")], "id long, url string")
    new = spark.createDataFrame([("b",), ("d",), ("c",), ("c",), (None,)], "url string").repartition(3)
    assert {(r.id, r.url) for r in HI.look_up_or_add(stored, new, "url").collect()} == {(7, "b"), (8, "c"), (9, "d")}
    assert HI.look_up_or_add(stored, new.limit(0), "url").count() == 0
    assert HI.first_by(stored, "id").first().url == "a" and HI.first_by(stored.limit(0), "id").count() == 0


def test_checkpoints_on_a_cluster_need_a_named_folder():
    from types import SimpleNamespace as N

    from mnemora import runtime

    absent = N(isDefined=lambda: False)
    context = N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: absent)), master="spark://host:7077", setCheckpointDir=lambda x: None)
    session = N(sparkContext=context, conf=N(get=lambda name, default: default))
    with pytest.raises(ValueError):
        runtime._checkpoint_dir(session)
    context.master = "local[2]"
    runtime._checkpoint_dir(session)


def test_migrations_run_once(spark, tmp_path, monkeypatch):
    from mnemora import archive

    seen = []
    monkeypatch.setattr(archive, "MIGRATIONS", [lambda f: seen.append(1), lambda f: seen.append(2)])
    assert archive.migrate(spark, str(tmp_path)) == 2 == archive.migrate(spark, str(tmp_path))
    archive.MIGRATIONS.append(lambda f: seen.append(3))
    assert archive.migrate(spark, str(tmp_path)) == 3 and seen == [1, 2, 3]
