"""Main text extraction on made-up hosts and, on the given pages, against a plain program."""

from __future__ import annotations

import html
import re

import pytest

from songloom.llm import html_templates
from songloom.llm.common import table
from songloom.llm.html_parts import parse, roles
from tests.llm.odd import no_docs, prose

SCHEMA = "page_id long, url string, html string, text string, _site string, main string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "mine", "s", "m") for i, u, h in rows], SCHEMA).repartition(3)


def _texts(spark, rows) -> dict:
    found = html_templates.extract_main_text(_frame(spark, rows))
    assert found.columns == ["page_id", "url", "_site", "main", "text"]
    return {row.page_id: row.text for row in found.collect()}


def _plain(source: str) -> str:
    """The article of a given page, by its tags alone."""
    inside = re.search("<article>(.*?)</article>", source, re.DOTALL)[1].replace("<br>", " ")
    blocks = [html.unescape(re.sub("</?b>", "", block)) for block in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(" ".join(block.split()) for block in blocks if block.strip())


def test_given_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {row.page_id: row for row in table(spark, sf_dir, "pages").collect()}
    found = html_templates.op12_html_extraction(spark, sf_dir).collect()
    assert sorted(row.page_id for row in found) == sorted(pages)
    for row in found:
        assert row.text == _plain(pages[row.page_id].html) and row.n_chars == len(row.text)
        assert row.url == pages[row.page_id].url


def _anonymous(n: int, article: list[str]) -> str:
    """A page whose markup says nothing about the roles of its parts."""
    body = "".join(f"<div class=k{n}><span>{x}</span></div>" for x in article)
    return (
        f"<html><body><div class='q1'><ul><li><a href=/a>Home</a><li><a href=/b>News {n}</a><li><a href=/c>Shop</a></ul></div>"
        f"<div class='q2'><h1>Title {n}</h1>{body}<div class='q5'>All rights reserved by us.</div></div>"
        f"<div class='q3'><div>Weather: {n} degrees</div><div>Become a friend of ours today</div></div></body>"
    )


def test_template_of_an_anonymous_host(spark):
    articles = {n: [prose(10 * n + k, 40) for k in range(2 + n % 4)] for n in range(12)}
    rows = [(n, f"https://a.example/{n}", _anonymous(n, article)) for n, article in articles.items()]
    found = _texts(spark, rows)
    for n, article in articles.items():
        assert found[n] == "\n".join([f"Title {n}", *article])
    templates = html_templates.deduce_templates(_frame(spark, rows)).collect()
    assert [(t.site, t.pages, t.main is not None) for t in templates] == [("a.example", 12, True)]
    assert len(templates[0].drop) == 2  # the two notices; links aren't text of their own


def test_copies_are_no_template(spark):
    same = [prose(k, 50) for k in range(6)]
    near = [[x if k != n else prose(900 + n, 50) for k, x in enumerate(same)] for n in range(6)]
    rows = [(n, "https://b.example/x", _anonymous(7, same)) for n in range(6)]
    rows += [(10 + n, f"https://c.example/{n}", _anonymous(n, x)) for n, x in enumerate(near)]
    found = _texts(spark, rows)
    for n in range(6):
        assert "\n".join(same) in found[n]
        assert "\n".join(near[n]) in found[10 + n]


def test_named_parts(spark):
    source = """<!doctype html><head><title>T</title><style>p{}</style></head>
    <body class="page has-sidebar"><header class=top><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
    <nav><p>Menu</p></nav><!-- <p>hidden</p> --><main><article><header><h1>Fish &amp; chips</h1></header>
    <p>One<br>two &nbsp; three<p>A <a href="x">link</a>, <em>stressed</em>ly.
    <div class="ad-box"><p>Buy</p></div><form><p>Name <input name=a></p></form><script>var a="</p><p>no";</script>
    <table><tr><td>1<td>2</table><ul><li><a href=a>a</a><li><a href=b>b</a><li><a href=c>c</a></ul>
    <section id=comments><article><p>First!</p></article></section></article></main>
    <aside>Related</aside><footer>&copy; Us</footer></body></html>"""
    found = _texts(spark, [(1, "http://one.example/a", source)])
    assert found[1].split("\n") == ["Fish & chips", "One two three", "A link, stressedly.", "1", "2", "a", "b", "c"]


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>no host"), (2, "no scheme", "<p>no host"), (3, "http://d.example/", None),
        (4, "http://d.example/", ""), (5, "http://d.example/", "<script>x"), (6, "http://d.example/", "<p <b>text</b> < > &am &#x41;"),
        (None, "http://d.example/", "plain"), (None, "http://d.example/", "plain"),
        (7, "http://USER@E.example:80?x", "<p>" + "word " * 200_000 + "</div></p>"), (8, "http://d.example", "<div>" * 3_000 + "deep"),
        (9, "http://d.example/", "<a href=\"<p>\">one</a>\x00 two three<p>"),
    ]
    frame = _frame(spark, rows)
    found = html_templates.extract_main_text(frame).collect()
    assert len(found) == len(rows)
    by_id = {row.page_id: row.text for row in found}
    assert by_id[1] == by_id[2] == "no host" and by_id[3] == by_id[4] == by_id[5] == ""
    assert by_id[6] == "text < > &am A" and by_id[None] == "plain" and by_id[8] == "deep"
    assert by_id[7] == "word " * 199_999 + "word" and by_id[9] == "one\x00 two three"
    empty = no_docs(spark).selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    assert html_templates.extract_main_text(empty).count() == 0


@pytest.mark.parametrize(
    ("events", "valid"),
    [
        ([1, 2, 3, 1, 2, 3], {1}),
        ([1, 2, 3, 1, 3, 2], set()),
        ([1, 10, 11, 12, 2, 3], {1, 10}),
        ([1, 10, 2, 11, 12, 3], {1}),  # the second class crosses the first
        ([1, 10, 11, 12, 2, 10, 11, 12, 3], {1}),  # and here it lies in two gaps
        ([1, 10, 11, 12, 10, 11, 12, 2, 3], {1, 10}),
    ],
)
def test_order_and_nesting(events, valid):
    classes = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}
    found = html_templates._class_orders(events, classes, {1: 3, 10: 3})
    assert {own for own, order in found.items() if order is not None} == valid


def test_unclosed_parts():
    page = parse("<ul><li>a<li>b<p>c<div>d</ul><dl><dt>e<dd>f</dl>g<h1>h<h2>i")
    assert [block.text for block in page.blocks] == list("abcdefghi")
    assert not any(roles(page).dropped)
