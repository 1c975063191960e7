import itertools
import random
import time

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import op06_html as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies, please accept them, this is a long notice with commas.</div>
<div class="content"><article><h1>Title &amp; more</h1><p>First   paragraph,\n with <b>bold<br>words</b> and a <a href="x">link</a>.<p>Yes.
<div class="ad">Buy now! It is cheap, very cheap, and good.</div><ul><li>One</li><li>Two</ul><p>Last&nbsp;one &lt;tag&gt; a &copy;.</p>
<section id="comments"><p>Great post, I loved it, thank you so much for sharing it with us all!</p></section></article></div>
<aside><p>Related things, which are long, and have commas, and go on for a while.</p></aside><form><p>Name <input></p></form>
<footer>&copy; 2024, all rights reserved, by the owner of this site.</footer></body></html>"""


def test_article_without_boilerplate():
    want = ["Title & more", "First paragraph, with bold words and a link.", "Yes.", "One", "Two", "Last one <tag> a ©."]
    assert op.main_text(PAGE).split("\n\n") == want


def test_page_without_article_is_told_by_its_text():
    page = "<div><a href=1>Home</a> <a href=2>About</a></div><div><p>" + "Words that go on, and on, for a while. " * 5 + "<p>Short.<p>" + "More words, as before, to read here. " * 5 + "</div>"
    got = op.main_text(page).split("\n\n")
    assert len(got) == 3 and got[1] == "Short." and "Home" not in op.main_text(page)


def test_the_cut_rescues_short_blocks_and_drops_a_long_one():
    long = "Words that go on, and on, for a while, and are read. " * 5
    page = f"<article><h2>Title</h2><p>{long}</p><p>Yes</p><ul><li>One<li>Two</ul><p>{long}</p><div class=promo><p>{long}</p></div></article><div class=teaser-box>{long}</div>"
    read = op.blocks_of(page)
    costs, kept = op.labelled(read)
    assert kept == [True] * 6 + [False, False]
    assert [c > 0 for c in costs] == [True, True, False, False, False, True, False, False]  # three labels differ from the sign of the block's own cost
    apart = "<div><div><div><p>Yes, it is so, and so.</p></div></div></div>" + "<div><a href=1>Links</a></div>" * 9
    assert op.main_text(apart) == ""  # the neighbours outweigh what the text says alone
    assert op.costs_of(op.blocks_of("<div><p>Yes, it is so, and so on, as we say.</p></div>"))[0] > 0


def labels(page, smooth=True):
    read = op.blocks_of(page)
    return op.minimum_cut(op.costs_of(read), op.smoothness(read) if smooth else {})


def test_the_cut_decides_labels_of_the_given_pages(monkeypatch):
    """Flow runs on most pages, without smoothness labels change, and the text is the article's all the same."""
    flows, reached = 0, op._reached

    def counted(*args):
        nonlocal flows
        flows += 1
        return reached(*args)

    monkeypatch.setattr(op, "_reached", counted)
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()
    changed = blocks = 0
    for (page,) in rows:
        with_it, without = labels(page), labels(page, False)
        changed += sum(a != b for a, b in zip(with_it, without, strict=True))
        blocks += len(with_it)
    assert flows > len(rows) / 3 and 0 < changed < blocks / 100  # the given pages are clean: their blocks' own costs are seldom wrong


def test_the_text_of_made_pages_is_that_of_their_article():
    rng = random.Random(16)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize()

    for k in range(200):
        article, inner = [words(5)], ""
        inner = f"<h1>{article[0]}</h1>"
        for _ in range(rng.randint(2, 8)):
            kind = rng.choice(["p", "p", "p", "short", "li", "h2", "ad"])
            text = words(rng.randint(1, 3) if kind == "short" else rng.randint(2, 6) if kind in ("li", "h2") else rng.randint(25, 90)) + rng.choice([".", ", yes.", ""])
            inner += {"li": f"<ul><li>{text}</li></ul>", "h2": f"<h2>{text}</h2>", "ad": f"<div class='ad-box'>{text}</div>"}.get(kind, f"<p>{text}</p>")
            article += [] if kind == "ad" else [text]
        last = words(60) + "."
        inner, article = inner + f"<p>{last}</p>", [*article, last]
        tag, name = rng.choice([("article", ""), ("main", ""), ("div", "post-content"), ("section", "entry")])
        links = "".join(f"<li><a href=#>{words(2)}</a></li>" for _ in range(rng.randint(3, 12)))
        page = f"<html><body><header><div>{words(3)}</div></header><nav><ul>{links}</ul></nav><{tag} class='{name}'>{inner}</{tag}><div class=sidebar><p>{words(40)}.</p></div><section id=comments><p>{words(30)}, {words(3)}.</p></section><footer>{words(9)}</footer></body></html>"
        assert op.main_text(page).split("\n\n") == article, k


def test_names_and_unclosed_elements_of_real_pages():
    assert op.main_text("<div class='container has-sidebar with-comments'><p>" + "A text, to read. " * 9 + "</div>").startswith("A text")
    assert op.main_text("<div class=sidebar-layout><article><h1>T</h1><p>Body here.</article></div>") == "T\n\nBody here."
    assert op.main_text("<article><p>One.</article><div class=related><article><p>Teaser, a long one, to click.</article></div>") == "One."
    assert op.main_text("<article><p>Before <button>Share<p>after.</article>").split("\n\n")[-1] == "after."
    assert op.main_text("<article><p>Before <svg><path/></svg> after.</article>") == "Before after."
    assert op.main_text(None) == "" and op.main_text("<nav><article><p>Card, with a text.</article></nav>") == ""


def test_cut_is_minimum_on_all_small_graphs():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 3) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}

        def cost(side):
            wrong = sum(abs(s) for s, k in zip(scores, side, strict=True) if (s > 0) != k)
            return wrong + sum(w for (a, b), w in edges.items() if side[a] != side[b])

        least = min(cost(side) for side in itertools.product((False, True), repeat=n))
        assert abs(cost(op.minimum_cut(scores, edges)) - least) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"'! -&;abpdivsctnh123#\n", max_size=200))
def test_any_input_is_read(page):
    assert isinstance(op.main_text(page), str)


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    for page in ("<p" * 50_000, '<a "' * 50_000 + ">", "<div>" * 50_000 + "x", "</p>" * 50_000, "<p>x" * 20_000, "<!--" * 50_000, "a > b", "<svg>" * 50_000, "<p>Yes.<li>Words that go on, and on, here.</li>" * 5_000, "<div class=ad>x</div><article>y</article>" * 3_000):
        op.main_text(page)
    assert time.time() - began < 20
    assert op.main_text("<article><p>" + "word " * 200_000).count("word") == 200_000


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(op.main_text(PAGE))), (1, len(op.main_text(PAGE))), (2, 0)]
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
