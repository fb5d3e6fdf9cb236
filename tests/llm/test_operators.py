import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import bpe, dedupe, mainbody, mixing, neardup, packing, readlevel, residue, sitelines, topn
from mnemora.runtime import cut

WORD = re.compile(r"[^\W_]+")
WORDS = [f"{a}{b}" for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "ola", "una", "ert", "ing", "osh")]


def docs(spark, texts, sources=None, first=1):
    rows = [(first + i, x, (sources or {}).get(first + i, "s.example"), f"http://s.example/{i}", f"Title {i}") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, url string, title string")


# near duplicates


def brute(texts, width, threshold, least):
    sets = {}
    for i, x in enumerate(texts, 1):
        w = WORD.findall((x or "").lower())
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[a] | sets[b]}


def edited(r, words):
    out = list(words)
    for _ in range(r.randint(0, 12)):
        k = r.randrange(len(out))
        out[k : k + r.randint(0, 2)] = r.sample(WORDS, r.randint(0, 2))
    if r.random() < 0.3:
        k = r.randrange(len(out))
        out = out[k:] + out[:k]
    return out


@pytest.mark.parametrize("seed,width,threshold", [(1, 3, Fraction(1, 2)), (2, 5, Fraction(4, 5)), (3, 2, Fraction(1, 3))])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, width, threshold):
    monkeypatch.setattr(neardup, "CELL_DOCS", 8)  # many runs go through the grid of cells
    monkeypatch.setattr(neardup, "BLOCK_WORDS", 4000)  # many blocks
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [r.choice(WORDS) for _ in range(r.randint(30, 200))]
        texts += [" ".join(edited(r, base)) for _ in range(r.randint(1, 14))]
    texts += [texts[0].upper(), texts[0].replace(" ", " , "), "x " * 50, "x " * 70, None, ""]
    r.shuffle(texts)
    got = [tuple(x) for x in neardup.found(docs(spark, texts).repartition(3), width=width, threshold=threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, width, threshold, 40)


def test_near_duplicate_classes(spark):
    base = " ".join(WORDS[:60])
    texts = [base, base.upper(), base + " more", "other " + " ".join(WORDS[50:110]), "short"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs(spark, texts)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0)}


def test_large_classes_are_tied_to_their_representative(spark):
    d = docs(spark, [" ".join(WORDS[:60])] * 9 + [" ".join(WORDS[:58] + WORDS[-1:])])
    got = {tuple(r) for r in neardup.found(d, expand=4).collect()}
    assert got == {(1, i) for i in range(2, 11)}
    every = {tuple(r) for r in neardup.found(d, expand=None).collect()}
    assert every == {(i, j) for i in range(1, 11) for j in range(i + 1, 11)}
    rep = {r.doc_id: r.class_id for r in neardup.classes(d).collect()}
    assert {tuple(r) for r in neardup.links(d).collect()} == {(1, 10)} and {i for i, c in rep.items() if c == 1} == set(range(1, 10))


def test_one_document_near_to_many(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"x{i}y{k}" for k in range(60)])) for i in range(1, 3001)] + [(5000, " ".join(base + base[:2]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in neardup.found(d, threshold=Fraction(2, 5)).collect()}
    assert got == {(i, 5000) for i in range(1, 3001)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50), st.booleans())
def test_packing_round_trip(xs, rising):
    a = np.array(sorted(xs) if rising else xs, np.int64)
    assert (packing.unpack(packing.pack(a, rising)) == a).all()


# tokens


@pytest.fixture(scope="module")
def ranks():
    if not Path(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken").exists():
        pytest.skip("no vocabulary here")
    return bpe.read_ranks()


def test_bpe_equals_a_public_encoder(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=80), st.text(alphabet="ab é日🙂'  \n1<|>", max_size=200)))
    def check(text):
        assert enc.encode(text) == other.encode_ordinary(text)

    check()
    for text in ("a" * 5000, "<|endoftext|> I'll", "zq" * 700, "\r\n\t  x"):
        assert enc.encode(text) == other.encode_ordinary(text)
    assert enc.encode("") == enc.encode(None) == []


def test_bpe_memo_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 10)
    enc = bpe.Encoder(ranks)
    enc.encode(" ".join(f"qqzx{i}w" for i in range(200)))
    assert len(enc.memo) <= 10


def test_long_piece_is_not_quadratic(ranks):
    import time

    def seconds(n):
        t = time.process_time()
        bpe.merge(bytes(random.Random(n).choices(range(97, 123), k=n)), ranks)
        return time.process_time() - t

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(5_000), 0.01)


# top n, duplicates, site lines


def test_top_n_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3, 4]), r.randint(0, 9), r.randint(0, 400)) for _ in range(3000)]
    rows = list({(g, i): (g, s, i) for g, s, i in rows}.values())
    groups = defaultdict(list)
    for g, s, i in rows:
        groups[g].append((-s, i))
    want = {(g, -s, i) for g, v in groups.items() for s, i in sorted(v)[:5]}
    df = spark.createDataFrame(rows + rows[:200], "h long, c long, l long").repartition(7)
    got = [tuple(x) for x in topn.top_n(df, "h", "c", "l", 5).collect()]
    assert len(got) == len(want) and set(got) == want


def test_hidden_duplicates(spark):
    urls = ["https://a.example/X?b=1&a=2", " HTTPS://A.EXAMPLE/x?a=2&&b=1# ", "https://a.example/x?a=2&b=1&b=1", "http://a.example/x?a=2&b=1", "https://a.example/x", "https://a.example/x/?", "https://a.example/x?a=2"]
    queries = ["Big cat -dog url:*x* title:y", "title:y  big CAT. -dog URL:*X*", "cat big -dog url:*x* title:y", "big cat dog url:*x* title:y", "big cat -dog url:x title:y", "ca*t", "cat", "“cat” ? -", "-url:a b", "b -url:a", "b url:a"]
    links = spark.createDataFrame(list(enumerate(urls, 1)), "id long, url string")
    hist = spark.createDataFrame(list(enumerate(queries, 1)), "id long, query string")
    got = {tuple(r) for r in dedupe.found(links, hist, 3).collect()}
    assert got == {("links", 1, 2), ("links", 5, 6), ("histories", 1, 2), ("histories", 7, 8), ("histories", 9, 10)}


def test_a_hot_class_over_many_partitions(spark):
    rows = [(i, "same" if i % 3 else f"k{i}") for i in range(3000)]
    got = dedupe.found(spark.createDataFrame(rows, "id long, url string"), spark.createDataFrame([], "id long, query string"), 13)
    assert {tuple(r) for r in got.collect()} == {("links", 1, i) for i, k in rows if k == "same" and i != 1}


def site_brute(texts, sources, least):
    where = defaultdict(set)
    for i, x in enumerate(texts, 1):
        for line in (x or "").split("\n"):
            if y := " ".join(line.lower().split()):
                where[sources[i], y].add(i)
    return {(i, k) for i, x in enumerate(texts, 1) for k, line in enumerate((x or "").split("\n")) if len(where.get((sources[i], " ".join(line.lower().split())), ())) >= least}


@pytest.mark.parametrize("held", [1 << 19, -1])
def test_site_lines(spark, monkeypatch, held):
    monkeypatch.setattr(sitelines, "HELD_LINES", held)
    r = random.Random(6)
    pool = ["Share this", "by the desk", "x", "", "Only one  two"]
    texts = ["\n".join(r.choice([p, p.upper(), f" {p}\t", f"line {r.randint(0, 60)}"]) for p in r.choices(pool, k=6)) for _ in range(60)]
    sources = {i: r.choice("ab") for i in range(1, 61)}
    d = docs(spark, texts, sources)
    want = site_brute(texts, sources, 5)
    got = [tuple(x) for x in sitelines.found(d).collect()]
    assert len(got) == len(want) and set(got) == want
    often = cut(sitelines.counted(d).select("k1", "k2"))
    rows, content = sitelines.marked(d, often)
    for x in rows.collect():
        assert content(x.source, x.text, x.gone)[0] == [y for k, y in enumerate(x.text.split("\n")) if (x.doc_id, k) not in want]


def test_clean_asks_for_texts_and_days(spark):
    import datetime as dt

    rows = [(i, "copied line\nfoot" if i < 9 else f"own {i}\nfoot", "s", dt.datetime(2024, 1, 1 + i % 3)) for i in range(18)]
    got = {r.doc_id: r.text for r in sitelines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string, captured_at timestamp")).collect()}
    assert got[0] == "copied line" and got[12] == "own 12"


def test_clean_without_dates_asks_for_texts(spark):
    import datetime as dt

    schema = "doc_id long, text string, source string, captured_at timestamp"
    rows = [(i, f"own {i}\nfoot", "one day", dt.datetime(2024, 1, 1)) for i in range(6)]
    rows += [(10 + i, f"own {i}\nfoot", "no day", None) for i in range(6)] + [(20 + i, "copied\nfoot", "copies", None) for i in range(9)]
    rows += [(30 + i, f"own {i}\nfoot", "days", dt.datetime(2024, 1, 1)) for i in range(6)] + [(36, "other", "days", dt.datetime(2024, 1, 2))]
    got = {r.doc_id: r.text for r in sitelines.clean(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == got[10] == "own 0" and got[20] == "copied\nfoot" and got[30] == "own 0\nfoot"
    got = {r.doc_id: r.text for r in sitelines.clean(spark.createDataFrame(rows, schema).drop("captured_at")).collect()}
    assert got[30] == "own 0"


# residue

SLOTS = ["{{ name }}", "${x.y}", "%CITY%", "%%city%%", "<%= title %>", "[[post_title]]", "__ITEM_NAME__", "@@user@@", "[object Object]", "{0}", "[TITLE]", "[insert link here]", "{% block x %}", "#{a.b}", "<!--#echo var=x-->"]


@pytest.mark.parametrize("slot", SLOTS)
def test_candidates_of_slots(slot):
    found, _ = residue.candidates(f"Dear {slot} of the town")
    assert found or residue.holds_default(f"Dear {slot} of the town")
    for text in (f'A slot such as "{slot}" is filled', f"print `{slot}` here"):
        assert not residue.candidates(text)[0] and not residue.holds_default(text)


@pytest.mark.parametrize("text", ["100% of it, 5 % more", "x_y and __init", "f(x) and (so on), “quoted” — it's", ""])
def test_no_candidates(text):
    assert not residue.candidates(text)[0]


def test_invisible_characters_are_no_delimiters():
    for text in ("\ufeffbom \U0001f468 here", "fi\u00adnal\u00adly", "\u200bzero\u200bwidth", "\\file.txt e\u0301"):
        assert not residue.candidates(text)[0], text


def test_default_titles():
    for x in ("undefined | Mysite", "Insert headline", "New page title here", "Untitled document", "ERROR"):
        assert residue.default_title(x, ["mysite"]), x
    for x in ("How we cut our 404 errors by half", "Error in the engine", "Loading the truck", "Mysite", " - "):
        assert not residue.default_title(x, ["mysite"]), x


def pages(spark, rows, source=lambda i: f"site{i % 7}.example"):
    return spark.createDataFrame([(i, x, t, source(i), f"http://{source(i)}/x") for i, x, t, *_ in rows], "doc_id long, text string, title string, source string, url string")


def sayer(seed):
    r = random.Random(seed)
    return lambda n: ". ".join(" ".join(r.choices(WORDS, k=9)).capitalize() for _ in range(n)) + "."


def check_residue(spark, rows):
    assert {x.doc_id for x in residue.found(pages(spark, rows)).collect()} == {r[0] for r in rows if r[3] == "case"}


def test_residue_induces_notices_of_any_wording(spark):
    say = sayer(3)
    rows = [(i, say(12) + "\nKept by the mill", f"T {i}", "plain") for i in range(60)]
    rows += [(100 + i, f"Калу спит у http://s.example/p{i} до {i} часов\nKept by the mill", f"T {i}", "case") for i in range(12)]
    rows += [(120 + i, say(8) + f"\nКалу спит у http://s.example/q{i} до {i} часов", f"U {i}", "case") for i in range(3)]
    rows += [(140 + i, say(10) + f"\nThe series has {i} parts at http://s.example/s{i}", f"V {i}", "plain") for i in range(20)]
    rows += [(170 + i, f"Kalu repose près de la vieille porte\n{'Kept by the mill' * (i % 2)}", f"W {i}", "case") for i in range(6)]  # no mask: the titles differ
    rows += [(180 + i, "Kind mules rested at 5 near the old gate", "Same", "plain") for i in range(10)]  # copies of a short text
    check_residue(spark, rows)


def test_residue_induces_delimiters(spark):
    say = sayer(4)
    names, marks = ["name", "title", "author", "city", "price"], [("⟦", "⟧"), ("~{", "}~"), ("[[", "]]"), ("$(", ")")]
    rows = [(i, say(5) + f" Dear {a}{n}{z} of the town. " + say(5), f"T {i}", "case") for i, (n, (a, z)) in enumerate((n, m) for n in names for m in marks)]
    rows += [(100 + i, say(5) + f" [{w.capitalize()}] packed it. " + say(3), f"T {i}", "plain") for i, w in enumerate(WORDS[:30])]
    rows += [(200 + i, say(5) + f' A slot such as "{a}name{z}" is filled. ' + say(3), f"T {i}", "plain") for i, (a, z) in enumerate(marks)]
    rows += [(300, say(6), "⟦ city ⟧", "case"), (301, "A tour of [[name]] in long templates\n" + say(6), "A tour of [[name]] in long templates", "plain"), (302, say(6), "Welcome $(author)", "case")]
    check_residue(spark, rows)


def test_residue_takes_no_paths_and_menus_for_slots(spark):
    say = sayer(9)
    names, marks = ["name", "title", "author", "city", "price"], [("⟦", "⟧"), ("~{", "}~"), ("[[", "]]"), ("$(", ")")]
    rows = [(i, say(5) + f" Dear {a}{n}{z} of the town. " + say(5), f"T {i}", "case") for i, (n, (a, z)) in enumerate((n, m) for n in names for m in marks)]
    rows += [(100 + i, f"Home > Kilamo > {WORDS[i]}\n" + say(6), f"K {i}", "plain") for i in range(30)]  # the site's own name, between three pairs
    rows += [(140 + i, say(3) + " It is at https://kilamo.example/x and in /srv/app/Kilamo/view too. " + say(3), f"U {i}", "plain") for i in range(5)]
    rows += [(200 + i, "Print | Mail | Save\n" + say(6), f"V {i}", "plain") for i in range(30)]  # a word between three pairs, two of which are used for other words
    rows += [(240 + i, say(3) + f" The file is in /{w}/view or |> {w} |> here. " + say(3), f"W {i}", "plain") for i, w in enumerate(["mail", *WORDS[:8]])]
    docs = pages(spark, rows, lambda i: "kilamo.example" if 100 <= i < 200 else f"site{i % 7}.example")
    assert {x.doc_id for x in residue.found(docs).collect()} == {r[0] for r in rows if r[3] == "case"}


def test_residue_induces_filler(spark):
    say, r = sayer(5), random.Random(6)
    latin = ["dolo", "ametu", "nibha", "urnam", "porta", "feliq", "tempo", "orna"]
    rows = [(i, " ".join(["lorem", "ipsum"] * (i % 2) + r.choices(latin, k=14)).capitalize() + ".", f"T {i}", "case") for i in range(20)]
    rows += [(50 + i, f"The word lorem was set by this printer in {i} of the books that they have. " + say(4), f"U {i}", "plain") for i in range(10)]
    rows += [(90, "foo bar foo bar foo bar foo bar foo bar", "t", "case"), (91, "xxx xx xxxx xx xxx", "t", "case"), (92, "", "t", "plain"), (93, None, "null", "case"), (94, say(5), "undefined | site3", "case"), (95, None, None, "plain")]
    check_residue(spark, rows)


def test_residue_takes_error_titles_from_their_records(spark):
    say = sayer(8)
    rows = [(i, f"Nothing lives at http://s.example/p{i}", "Kalu gone", "case") for i in range(8)]
    rows += [(20, say(9), "Kalu gone", "case")] + [(30 + i, say(9), f"T {i}", "plain") for i in range(30)]
    check_residue(spark, rows)


def test_residue_induces_slots_without_delimiters(spark):
    say = sayer(7)
    forms = ["Welcome back, {}!", "Dear {}", "Written by {}.", "{} sent you a card"]
    names = ["Anna", "Bo Lind", "Cato", "Dora", "Emil"]
    rows = [(i * 10 + k, f.format(x) + "\n" + say(6), f"T {i}{k}", "plain") for i, f in enumerate(forms) for k, x in enumerate(names)]
    rows += [(100, "Welcome back, undefined!\n" + say(6), "a", "case"), (101, "Dear customer_name\n" + say(6), "b", "case"), (102, say(6) + "\nWritten by .", "c", "case"), (103, "null sent you a card\n" + say(6), "d", "case"), (104, "Welcome back, !\n" + say(6), "e", "case")]
    rows += [(110, "The result is undefined.\n" + say(6), "f", "plain"), (111, "Set max_size to five.\n" + say(6), "g", "plain"), (112, 'Welcome back, "undefined"!\n' + say(6), "h", "plain")]
    check_residue(spark, rows)


def test_number_of_words_counts_site_lines():
    text = " ".join(f"w{i}" for i in range(50)) + "\nprinted by the mill"
    total, words = readlevel._content_words(lambda source, text, gone: sitelines.parted(text, {1}), "s", text, None)
    assert (total, len(words)) == (54, 50)


# main body


def test_alignment_and_labels():
    html = '<head><title>x</title></head><body><nav><a href="/">Home</a><a>Docs</a></nav><article><h1>Head &amp; tail</h1><p>Some <a>linked</a> text</p><div class="tools"><span>Share</span></div></article><script>no</script><footer>End</footer>'
    lines = ["Home", "Docs", "Head & tail", "Some linked  text", "Share", "End", "missing"]
    leaves = mainbody.align(lines, html)
    assert [f.label if f else None for f in leaves] == [-1, -1, 1, 1, 0, -1, None]
    assert leaves[0].link and leaves[2].tags[-1] == "h1"


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(1)
    field = mainbody.Field(r.normal(size=mainbody.FEATURES), r.normal(size=(2, 2)), r.normal(size=(2, 2)))
    for _ in range(20):
        lines = [r.integers(0, mainbody.FEATURES, 3).tolist() for _ in range(6)]
        s = [field.w[f].sum() for f in lines]
        best = max(range(64), key=lambda m: sum(s[i] for i in range(6) if m >> i & 1) + field.ends[0, m & 1] + field.ends[1, m >> 5 & 1] + sum(field.trans[m >> i & 1, m >> i + 1 & 1] for i in range(5)))
        assert field.decode(lines).tolist() == [bool(best >> i & 1) for i in range(6)]


def made_page(r, named):
    cls = (lambda x: x) if named else (lambda x: "z" + str(abs(hash(x)) % 97))
    say = lambda: " ".join(r.choices(WORDS, k=r.randint(14, 30))).capitalize() + "."
    title = " ".join(r.choices(WORDS, k=4))
    parts = [("nav", f'<div class="{cls("topbar")}"><a>{m}</a></div>', m, 0) for m in r.sample(["Home", "Docs", "Forum", "Jobs", "Search"], 3)]
    body = [("h", f"<h1>{title}</h1>", title, 1)] + [("p", f"<p>{(x := say())}</p>", x, 1) for _ in range(r.randint(2, 5))]
    body.insert(r.randint(2, len(body)), ("s", f'<div class="{cls("tools")}"><span>Share on Site</span></div>', "Share on Site", 0))
    foot = [("f", f'<div class="{cls("foot")}"><p>{x}</p></div>', x, 0) for x in ("Back to top", "Copyright Site 2012")]
    html = "".join(x[1] for x in parts) + f'<div class="{cls("post-body")}">' + "".join(x[1] for x in body) + "</div>" + "".join(x[1] for x in foot)
    rows = parts + body + foot
    return title, "\n".join(x[2] for x in rows), f"<body>{html}</body>", [x[3] for x in rows]


def test_field_learns_and_carries_over():
    r = random.Random(8)
    train = [p for _ in range(60) for t, x, h, _ in [made_page(r, True)] for p in mainbody.examples(t, "http://site.example/", x, h)]
    assert len(train) == 180
    field = mainbody.fit(train)
    wrong = total = 0
    for k in range(60):
        t, x, h, y = made_page(r, k % 3 == 0)
        got = mainbody.decode(field, t, "http://site.example/", x, None if k % 3 == 2 else h)
        wrong += len(set(got) ^ {i for i, v in enumerate(y) if v})
        total += len(y)
    assert wrong / total < 0.02


def test_long_pages_are_read_in_linear_time():
    import time

    def seconds(n):
        lines = [f"entry {i} of the list" for i in range(n)]
        html = "<ul>" + "".join(f'<li class="c"><a>{x}</a></li>' for x in lines) + "</ul>"
        t = time.process_time()
        mainbody.features("T", "http://site.example/", lines, mainbody.align(lines, html))
        return time.process_time() - t

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.05)


# mixing


def test_plan():
    assert mixing.plan({}, {"a": (1.0, 1)}) == {}
    p = mixing.plan({"a": 100, "b": 1000, "x": 5}, {"a": (0.5, 2), "b": (0.3, 1), "none": (0.2, 3)})
    assert p["a"] == pytest.approx(2) and p["b"] * 1000 / (p["a"] * 100) == pytest.approx(0.6)


def test_pivot_keeps_expectation_and_settles():
    r = random.Random(2)
    for _ in range(300):
        a, b = (r.randint(0, 9**9), r.randint(1, 500), r.random()), (r.randint(0, 9**9), r.randint(1, 500), r.random())
        settled, left = mixing.pivot(a, b)
        assert len(settled) + (left is not None) == 2 and settled
        if left:
            assert a[1] * a[2] + b[1] * b[2] == pytest.approx(sum(n * x for _, n, x in settled) + left[1] * left[2])


def test_mix_meets_targets(spark):
    if not Path(bpe.TOKENIZERS).exists():
        pytest.skip("no vocabulary here")
    r = random.Random(5)
    rows = [(i, r.choice(["a"] * 5 + ["b"] * 3 + ["c", None, "other"]), " ".join(r.choices(WORDS, k=r.randint(1, 60)))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, collection string, text string").repartition(40)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("empty", 0.1, 9)], "collection string, target_share double, max_repeats int")
    selection, shares = mixing.mix(d, t)
    s = {x.collection: x for x in shares.collect()}
    most = max(len(x[2]) for x in rows)
    total = sum(x.selected_tokens for x in s.values())
    for c, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s[c].selected_tokens - w * total) <= 2 * most and s[c].share == pytest.approx(w, abs=0.01)
    assert s["empty"].selected_tokens == 0
    got = selection.collect()
    assert len({x.doc_id for x in got}) == len(got) and all(0 < x.copies <= {"a": 1, "b": 2, "c": 3}[x.collection] for x in got)
    assert Counter(x.collection for x in got)["c"] == Counter(x[1] for x in rows)["c"]  # the scarce one is used up
    assert {tuple(x) for x in mixing.selection(d.repartition(3, "text"), t).collect()} == {tuple(x) for x in got}


def test_mix_does_not_depend_on_the_layout(spark, monkeypatch):
    if not Path(bpe.TOKENIZERS).exists():
        pytest.skip("no vocabulary here")
    monkeypatch.setattr(mixing, "LEAF_DOCS", 20)
    d = spark.createDataFrame([(i, "ab"[i % 2], " ".join(WORDS[: 3 + i % 40])) for i in range(900)], "doc_id long, collection string, text string")
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "collection string, target_share double, max_repeats int")
    one, other = ({tuple(x) for x in mixing.selection(x, t).collect()} for x in (d.repartition(5), d.orderBy("text").coalesce(1)))
    assert one == other and len(one) > 400


# reading level


def graded(r, level):
    easy, hard = WORDS[:40], [w + "ization" for w in WORDS[:40]]
    return [w if r.random() > level / 12 else h for w, h in zip(r.choices(easy, k=600), r.choices(hard, k=600))] + ["the", "of", "and", "this", "that", "by"] * 20


def test_levels_on_held_out_documents():
    r = random.Random(7)
    docs_ = [(i, graded(r, g), float(g)) for i in range(300) for g in [1 + i % 5]]
    model = readlevel.fit(docs_[:200])
    hard = [(model.predict(w) >= readlevel.DEMANDING) == (g >= 4) for _, w, g in docs_[200:]]
    assert sum(hard) / len(hard) > 0.9
    assert readlevel.fit([]).predict(["x"] * 50) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=127), st.characters()), max_size=60))
def test_words_are_runs_of_letters_and_digits(text):
    assert readlevel.split_words(text) == WORD.findall(text.lower())


def test_english():
    assert readlevel.is_english("the cat of this town saw that dog and it was by the door".split())
    for x in ("die katze und der hund in der stadt mit einer alten tür".split(), "la casa de los perros y el gato con una puerta".split(), "la maison et les chiens avec une porte sur cette place".split(), ["xx"] * 30, []):
        assert not readlevel.is_english(x)


def test_words_have_the_grade_of_their_use():
    g = readlevel.word_grades([(["easy", "both"], 1), (["easy", "both"], 1), (["easy"], 1), (["hard", "both"], 5), (["hard"], 5), (["hard"], 5)])
    assert g["easy"] < g["both"] < g["hard"]
