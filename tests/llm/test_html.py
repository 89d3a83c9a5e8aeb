"""Main text against hand-made pages and against the article element of the given pages."""

import html as entities
import re

import numpy as np
from weekwise.llm import html
from weekwise.llm.registry import QUERIES

TREE = html.grow(np.array(html.LABELLED)[:, :-1], np.array(html.LABELLED)[:, -1])

CASES = [
    ("", ""), (None, ""), ("   \n ", ""), ("<html><body></body></html>", ""),
    ("<body><header><a href=/>Home</a> Site</header><main><h1>A &amp; B</h1><p>One\n two&nbsp;three.</p></main><footer>c</footer>", "A & B\nOne two three."),
    ("<article><header><h1>T</h1></header><p>x <b>bold<i>er</i></b> y</p><section class='comments'><p>I like it very much, thanks</p></section></article>", "T\nx bolder y"),
    ("<article><p>a<script>if (a</p>b) { '<p>no</p>' }</script>b</p><style>p{}</style><form><input value='x'>Name <button>Go</button></form><p>c</article>", "ab\nc"),
    ("<nav><ul><li><a href='/'>x</a></ul></nav><article><p>1 &lt; 2 < 3</p><!-- <p>gone</p> --><p>&#233;&#x1F642;</p></article>", "1 < 2 < 3\né🙂"),
    ("<div id='cookie-notice'>We use cookies to serve you better, agree?</div><article><p>Short.</p></article><aside><p>See also this long story of ours</p></aside>", "Short."),
    ("<article><p>Text</p><div class='ad'>Buy now</div><ul><li>item one</li><li>item two</li></ul><p title='a > b'>End</p></article>", "Text\nitem one\nitem two\nEnd"),
    ("<ARTICLE><P>Upper<BR>case</P></ARTICLE><DIV CLASS=\"sidebar\">Side</DIV>", "Upper\ncase"),
]


def test_cases():
    for page, want in CASES:
        assert html.main_text(page, TREE) == want, page


def test_tree_fits_its_table():
    assert all(html.is_article(TREE, r[:-1]) == bool(r[-1]) for r in html.LABELLED)


def test_pages_without_article_element():
    body = " ".join(f"word{i}" for i in range(60))
    page = f"<ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul><h2>A title of some length, really</h2><p>{body}</p><p>{body}</p><ul><li><a href=/c>Next</a><li><a href=/d>Prev</a></ul>"
    assert html.main_text(page, TREE) == f"A title of some length, really\n{body}\n{body}"


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows(spark):
    frame = spark.createDataFrame([(1, None, "<p>" + "a b " * 40000, "x"), (1, None, None, "x"), (None, "u", "<<<<'\"" * 500, "x")], "page_id bigint, url string, html string, text string")
    rows = html.extract(frame).collect()
    assert sorted((str(r.page_id), r.n_chars == len(r.text)) for r in rows) == [("1", True), ("1", True), ("None", True)]
    assert max(r.n_chars for r in rows) == 2 * 80000 - 1
    assert html.extract(frame.limit(0)).count() == 0


def test_wrappers_and_captions():
    """Captions and text below a wrapper that only tells of the layout belong to the article; what stands around it still goes."""
    article = "<p>One two three.</p><figure><img src=x><figcaption>A caption.</figcaption></figure>"
    want = "One two three.\nA caption."
    for page in (
        f"<article>{article}</article>", f"<main class='content has-sidebar'>{article}</main>", f"<div class='layout no-comments'><article>{article}</article></div>",
        f"<div id='share-wrap'><article class='share'>{article}</article></div>", f"<div class='with-widget'><main>{article}</main></div>",
    ):
        assert html.main_text(page, TREE) == want, page
        rest = "<div class='comments'><article><p>I like it very much, thanks</p></article></div><div class='sidebar'>Side</div>"
        assert html.main_text(page + rest, TREE) == want, page


def test_attributes():
    """Marks are attributes of their own name, never words within other values."""
    text = "<p>One two three.</p>"
    for page in (
        f'<article style="overflow:hidden">{text}</article>', f'<div aria-hidden="false"><article>{text}</article></div>',
        f'<article><div title="a hidden story">{text}</div></article>', f"<article><div data-class='sidebar' data-role=dialog>{text}</div></article>",
        f"<article><section class='notification-basics'>{text}</section></article>", f"<article><div class='menu-of-the-day ads-explained'>{text}</div></article>",
    ):
        assert html.main_text(page, TREE) == "One two three.", page
    for mark in ("hidden", "aria-hidden='true'", "class='comments-list'", "class=share-buttons", "id=ad-3", "class='x siteFooter'", "role='dialog'"):
        assert html.main_text(f"<article>{text}<div {mark}><p>Something else stands here</p></div></article>", TREE) == "One two three.", mark


def test_links_in_an_article():
    page = "<nav><a href=/>Home</a></nav><article><p>Body text.</p><h2>References</h2><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li><li><a href=/3>Third</a></li></ul></article>"
    assert html.main_text(page, TREE) == "Body text.\nReferences\nFirst source\nSecond source\nThird"
