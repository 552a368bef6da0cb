"""Main text of pages: marked roles, broken markup, and branches that a host repeats."""

import html
import re

import pytest

from payouts.llm import queries, style_tree

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{color:red}</style><script>var a="</p><article>x</article>";</script></head><body class="nav-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Fish &amp; chips&nbsp;</h1></header><p>One <b>two</b>three<br>four
<p>Five &lt;six&gt; &#233;&#x1F642;<!-- hidden <p>x</p> --><div class="ad">Buy</div><ul><li>a<li>b</ul>
<form><input name=q><button>Go</button></form><section id="comments"><p>First!</p></section><aside>Side</aside></article>
<div class="sidebar"><p>Links</p></div><footer>&copy; Site</footer></body></html>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Fish & chips\nOne twothree four\nFive <six> é\U0001f642\na\nb"),
    ("", ""),
    ("plain text < 3 & more", "plain text < 3 & more"),
    ("<p>open <b>bold", "open bold"),
    ("<div><p>a</div><p>b</p></p></div>c", "a\nb\nc"),
    ("<script>unclosed <p>x", ""),
    ("<p title='a > b'>x</p><p hidden>y</p><p style='display:none'>z</p>", "x"),
    ("<main><p>in</p></main><p>out</p>", "in"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<" * 2000 + "x", "<" * 2000 + "x"),
    ("<a " + "\"" * 3001, "<a " + "\"" * 3001),
])
def test_pages(page, text):
    assert style_tree.walk_page(page)[0] == text


def test_repeated_branches_go(spark):
    """Without marked roles the tree finds what a host repeats; content that differs from page to page stays."""
    page = "<html><body><div class=top><p>Welcome to our site</p></div><div class=text><p>Story {0} is new</p><p>More of {0}</p></div><div class=end><span>All rights reserved</span></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(i)) for i in range(12)] + [(100, "https://one.example/", page.format("single")), (101, None, None), (102, "x", "<p>y</p>"), (100, "https://one.example/", page.format("single"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS salt", "3 AS text")
    found = style_tree.extracted(pages)
    assert found.columns == ["page_id", "url", "text"] and found.count() == len(rows)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert all(texts[i] == f"Story {i} is new\nMore of {i}" for i in range(12))
    assert texts[100] == "Welcome to our site\nStory single is new\nMore of single\nAll rights reserved" and texts[101] == "" and texts[102] == "y"
    assert style_tree.extracted(pages.limit(0)).count() == 0


def test_pages_of_the_sample(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, folder).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def texts_of(spark, pages):
    rows = [(i, "https://h.example/", page) for i, page in enumerate(pages)]
    return [r["text"] for r in style_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_tree_decides_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p><b>Note:</b> story {0} is new</p><table><tr><th>Size<td>{0}</table><div class=bio><h3>About Ann</h3><p>Ann writes here</p></div></article></body>"
    assert texts_of(spark, [page.format(i) for i in range(5)]) == [f"Title {i}\nNote: story {i} is new\nSize\n{i}" for i in range(5)]


def test_body_outside_teaser_articles(spark):
    page = "<body><div class=text><p>Story {0} is long and new, and it goes on for {0} lines</p></div><article class=card><p>Read this too</p></article><article class=card><p>And that</p></article></body>"
    assert texts_of(spark, [page.format(i) for i in range(5)]) == [f"Story {i} is long and new, and it goes on for {i} lines" for i in range(5)]
    assert "goes on for 7 lines" in style_tree.walk_page(page.format(7))[0]


def test_copies_of_a_page_are_one(spark):
    page = "<body><div class=top><p>Welcome</p></div><div class=text><p>Story {0} is new</p></div></body>"
    assert texts_of(spark, [page.format(1)] * 4) == ["Welcome\nStory 1 is new"] * 4
    found = texts_of(spark, [page.format(max(0, i - 90)) for i in range(100)])
    assert found == [f"Story {max(0, i - 90)} is new" for i in range(100)]


@pytest.mark.parametrize(("page", "text"), [
    ("<article class='post has-sidebar'><div class=entry-header><h1>Head</h1></div><p>x</p></article>", "Head\nx"),
    ("<main class=no-sidebar id=search><div class=header><h1>Head</h1></div><p>x</p></main>", "Head\nx"),
    ("<div class=search-results><p>x</p></div><div class='related'>y</div><div class=social>z</div>", "x\ny\nz"),
    ("<div class='box Sidebar'>x</div><div id=comments>y</div><div class=site-header>z</div><p>in</p>", "in"),
])
def test_names_of_roles_are_whole(page, text):
    assert style_tree.walk_page(page)[0] == text
