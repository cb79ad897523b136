"""Main texts: the sample pages by a plain rule, and hand-made pages."""

import html
import re
import time

import pytest

from lendlens.llm import density, queries
from tests.conftest import TESTDATA


def test_query(spark):
    rows = queries.op9_text_density(spark, f"{TESTDATA}/sf0.1").collect()
    pages = spark.read.parquet(f"{TESTDATA}/sf0.1/pages.parquet").collect()
    made = {row["page_id"]: row for row in rows}
    assert len(rows) == len(pages)
    for page in pages:
        # Every sample page has one article; what follows an unclosed one is a footer.
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        text = " ".join(html.unescape(inner).split())
        assert (made[page["page_id"]]["text"], made[page["page_id"]]["n_chars"]) == (text, len(text))


LONG = "This is a rather long sentence of the main text, with enough words to be dense. " * 3
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="home">
<header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies {LONG}</div>
<div class="menu"><a href=1>One</a> <a href=2>Two</a></div>
<div class="x1"><h1>Title &amp; more</h1><p>{LONG}<p>Short.<p>{LONG}<ul><li>first<li>second</ul>
<form><input name=q> Search {LONG}</form><script>if (a < b) {{ document.write("<p>no</p>") }}</script>
<p>A&nbsp;link: <a href="x>y">here</a>, <i>in</i>line.</p></div>
<div class="sidebar">{LONG}</div><section id="comments"><p>{LONG}</p></section>
<div><a href=1>Related one</a> <a href=2>Related two</a></div><footer>{LONG}</footer>"""


def test_page_without_article():
    own = " ".join(LONG.split())
    assert density.extract(PAGE) == f"Title & more {own} Short. {own} first second A link: here, inline."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("plain text", "plain text"),
        ("<p>a<p>b<br>c<!-- d --><b>e</b>f", "a b cef"),
        ("<script>var a = '</p>';", ""),
        ("<!-- never ends <p>x</p>", ""),
        ("<article><p>a &lt;b&gt; &copy; &#233;</p></article><p hidden>x</p>", "a <b> © é"),
        ("<article><header><h1>H</h1></header><p>x y</p><nav>n</nav></article>", "H x y"),
        ("<main><p>x</p><div class='ad'>buy</div><p>y</p></main>", "x y"),
        ("</div></p><p>x</p></span>", "x"),
        ("a <3 b", "a <3 b"),
        ("<div><div><div><p>" * 300 + "deep", "deep"),
    ],
)
def test_small_pages(page, text):
    assert density.extract(page) == text


def test_density_falls_with_links():
    plain, linked = (
        density.measure(density.tree(f"<div><p>{body}</p><p>{body}</p></div>"))[1].density
        for body in (LONG, f"<a href=1>{LONG[:100]}</a>{LONG[100:]}")
    )
    assert plain > linked > 0


def test_edges(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "u", "<p>" + "word " * 200_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = sorted((row["page_id"], row["n_chars"]) for row in density.extracted(pages).collect())
    assert made == [(1, 0), (1, 0), (2, 999_999)]
    assert density.extracted(pages.limit(0)).count() == 0


OWN = " ".join(LONG.split())
TEXT = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
WIDGET = "<div class='elementor-widget elementor-widget-text-editor'>{}</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='layout has-sidebar'><article>{TEXT}</article><div class=sidebar>{LONG}</div></div>",
        f"<body><div class='sidebar-layout'><main>{TEXT}</main></div><div id=comments>{LONG * 9}</div>",
        f"<body><div class='layout has-sidebar'><div>{TEXT}</div><div class=sidebar>{LONG}</div></div>",
        "<body><div>" + "".join(map(WIDGET.format, TEXT.replace("</p>", "</p>\0").split("\0"))) + "</div>",
        "<main>" + "".join(map(WIDGET.format, TEXT.replace("</p>", "</p>\0").split("\0"))) + "</main>",
        f"<div id='search-results'>{TEXT}</div><footer>{LONG}</footer>",
        f"<form id=aspnetForm method=post><div class=menu><a href=1>One</a></div><div>{TEXT}</div></form>",
        f"<form action=/><div><article>{TEXT}</article></div></form>",
        f"<main data-nav='hidden'>{TEXT}</main>",
        f"<div data-id='comments' title='role=banner hidden'>{TEXT}</div>",
        f"<article>{TEXT}</article><div class=comments>{LONG * 20}</div>",
        f"<article>{TEXT}<div class=related>{LONG}</div></article><form>{LONG}</form>",
        f"<article>{TEXT}<article class=comment>{LONG}</article></article>",
        f"<article class='post widget'>{TEXT}</article><div class=comments><article>{LONG}</article></div>",
    ],
)
def test_wrappers_that_mention_a_listed_word(page):
    assert density.extract(page) == f"Title {OWN} {OWN} {OWN}"


def test_link_lists_inside_an_article_stay():
    page = f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></article>"
    assert density.extract(page) == f"{OWN} One Two"


def test_unclosed_tags_take_time_in_proportion():
    for opening, closing in (("<b>", "</i>"), ("<span>", "<p>"), ("<b>", "</x>")):
        began = time.process_time()
        density.tree(opening * 60_000 + "text" + closing * 60_000)
        assert time.process_time() - began < 5
