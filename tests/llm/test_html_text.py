"""Main text of pages: layouts with and without semantic elements, broken markup, and the given pages against a plain cut of their template."""

import html
import re

import pytest
from pyspark.sql import functions as F

from folioworks.llm import html_text
from folioworks.llm.queries import op12_html_extraction

LONG = "The harbour was silent in the early morning while the fishermen prepared their nets and talked about the weather of the week"
ALSO = "Nobody had expected the old lighthouse keeper to return, least of all the mayor, who had signed the letter himself in spring"
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Shop", "About")) + "</ul>"
BODY = f"<h1>A title</h1><p>{LONG}.</p><p>Short.</p><p>{ALSO}.</p>"
TEXT = f"A title\n{LONG}.\nShort.\n{ALSO}."

LAYOUTS = {
    "article with everything around": f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>{LONG}';</script></head><body><header><h2>Site</h2>{MENU}</header><nav>{MENU}</nav>"
    f'<div class="cookie-notice">{LONG}</div><aside><p>{LONG}</p></aside><article>{BODY}</article><form><label>Mail</label><input><button>Go</button></form><footer>&copy; {LONG}</footer></body></html>',
    "main and comments": f'<body><div id="masthead">Site</div><main>{BODY}<section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section></main></body>',
    "nested article is a comment": f"<body><article>{BODY}<article><p>{ALSO}</p></article></article></body>",
    "divisions with names": f'<body><div class="top-nav">{MENU}</div><div class="wrap"><div class="content">{BODY}</div><div class="sideBar widget"><p>{LONG}</p></div></div><div class="page-footer"><p>{LONG}</p></div></body>',
    "divisions without names": f"<body><div>{MENU}</div><div><div>{BODY}</div></div><div>{MENU}</div></body>",
    "loose paragraphs": f"<body><div>{MENU}</div>{BODY}<div>{MENU}</div></body>",
    "no ends": f"<body><nav>{MENU}</nav><article><h1>A title<p>{LONG}.<p>Short.<p>{ALSO}.",
    "an advert left open": f'<body><div class="ad">Buy now<article>{BODY}</article></body>',
    "advert, share bar and figures within": f'<body><article><h1>A title</h1><div class="share-bar">{MENU}</div><p>{LONG}.</p><div class="ad-slot">{ALSO}</div><p>Short.</p><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul><p>{ALSO}.</p></article></body>',
    "hidden parts": f'<body><article><h1>A title</h1><p hidden>{LONG}</p><p style="display: none">{LONG}</p><p aria-hidden="true">x</p><p>{LONG}.</p><p>Short.</p><p>{ALSO}.</p></article></body>',
    "header within the article": f"<body><header>Site</header><article><header><h1>A title</h1></header><p>{LONG}.</p><p>Short.</p><p>{ALSO}.</p><footer>Tags</footer></article></body>",
    "table page": f"<table><tr><td>{MENU}<td>{BODY}</td></tr></table>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert html_text.main_text(LAYOUTS[name]) == TEXT


def test_blocks_space_and_references():
    page = "<article><p>a &amp;lt; b&nbsp;&nbsp;c\n\t<b>d</b>e&#233;&hellip;<br>f &copy</p>\n<ul><li>one <i>x</i></li><li>two</li></ul><blockquote>q<p>r</blockquote><!-- no --><p> </p>&#xD800;</article>"
    assert html_text.main_text(page) == "a &lt; b c deé… f ©\none x\ntwo\nq\nr\n�"


def test_inner_marked_span_goes():
    assert html_text.main_text('<article><p>one <span class="ad">buy</span> two <span class="x">three</span></p></article>').split() == ["one", "two", "three"]


def test_smoothing_is_a_weighted_mean():
    assert html_text.smoothed(html_text.np.array([3.0])) == pytest.approx([3.0])
    got = html_text.smoothed(html_text.np.array([0.0, 0, 0, 0, 9, 0, 0, 0, 0]))
    assert got.argmax() == 4 and got[8] == 0 and got[3] == pytest.approx(got[5]) and got.sum() == pytest.approx(9)
    assert html_text.smoothed(html_text.np.full(9, 4.0)) == pytest.approx([4.0] * 9)


@pytest.mark.parametrize("page", [None, "", " \n", "<html></html>", "<article></article>", "<nav>menu</nav>", "<script>x</script>", "<!-- open", "<p", "<article><p>", "<![CDATA[ x", "&"])
def test_pages_without_article(page):
    assert html_text.main_text(page) in ("", page)


def test_feeding_in_pieces_changes_nothing(monkeypatch):
    whole = [html_text.main_text(p) for p in LAYOUTS.values()]
    monkeypatch.setattr(html_text, "FEED", 7)
    assert [html_text.main_text(p) for p in LAYOUTS.values()] == whole


def test_rows(spark):
    big = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", LAYOUTS["loose paragraphs"]), (None, None, None), (2, "v", ""), (2, "v", ""), (3, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=repr)
    texts = {1: TEXT, 2: "", None: "", 3: "\n".join(f"{LONG} {i}" for i in range(20_000))}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_given_pages_against_their_template(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op12_html_extraction(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S).group(1))
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in blocks)
        assert got[i]["text"] == "\n".join(b for b in blocks if b)
        assert got[i]["n_chars"] == len(got[i]["text"])
