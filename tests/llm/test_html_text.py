from __future__ import annotations

import html
import re

import numpy as np
import pytest

from quorate.llm.common import prepared
from quorate.llm.decision_tree import Tree
from quorate.llm.html_blocks import text_blocks
from quorate.llm.html_text import features, fitted, main_text, main_texts

from .helpers import prose

SCHEMA = "page_id bigint, url string, html string, text int, n_chars string, lang string"


def page(k):
    """A page with all that stands beside an article, and the text of the article."""
    h1, first, second, last = prose(k, 7), prose(k + 1, 60), prose(k + 2, 1), prose(k + 3, 25)
    body = (
        f"<h1>{h1} &amp; &eacute;t&#233;</h1><p><b>{first}<br><p>{second}.</p>"
        f"<script>if (a<b) document.write('<p>no</p>')</script><!-- <p>no</p> -->"
        f"<p>{last[:40]}  \n\t {last[40:]}</p><div class='ad-box'>buy {prose(k + 4, 20)}</div>"
        f"<section id='comments'><p>{prose(k + 5, 40)}</p></section>"
    )
    whole = (
        f"<!DOCTYPE html><html><head><title>{h1}</title><style>p{{margin:0}}</style></head><body"
        f" class='single sidebar-left'><header><p>{prose(k + 6, 9)}</p></header><nav><ul>"
        + "".join(f"<li><a href='/{i}'>{prose(i, 1)}</a></li>" for i in range(5))
        + f"</ul></nav><div class='cookieNotice'>{prose(k + 7, 30)}</div><article>{body}</article>"
        f"<aside>{prose(k + 8, 50)}</aside><form>name <input value='<p>x</p>'><button>go</button>"
        f"</form><footer>&copy; {prose(k + 9, 12)}</footer></body></html>"
    )
    return whole, " ".join(f"{h1} & été {first} {second}. {last[:40]}   {last[40:]}".split())


def test_tree_knows_its_table_and_splits():
    x = np.array([[0, 3], [0, 9], [1, 3], [1, 9.0]])
    y = np.array([True, False, False, False])
    tree = Tree.fit(x, y)
    assert [tree(row) for row in x.tolist()] == y.tolist()
    assert Tree.fit(x[:0], y[:0]).root is True
    assert Tree.fit(x[[0, 0]], np.array([True, False])).root is True


def test_articles_come_out_whole_and_alone():
    tree = fitted()
    for k in range(0, 200, 10):
        whole, want = page(k)
        assert main_text(whole, tree) == want
        assert main_text(whole.upper().replace("&AMP;", "&amp;").replace("&EACUTE;", "&Eacute;"),
                         tree).lower() == want.lower()


def test_pages_without_marked_article():
    tree = fitted()
    long, longer = prose(1, 60), prose(2, 90)
    links = "".join(f"<td><a href=x>{prose(k, 2)}</a></td>" for k in range(6))
    assert main_text(f"<table><tr>{links}<td>{long}</td><td>{longer}</td></tr></table>",
                     tree) == f"{long} {longer}"
    assert main_text(f"<div id=menu>{long}</div><p>{longer}</p><p><a href=x>{prose(3, 9)}</a></p>",
                     tree) == longer


@pytest.mark.parametrize("source, want", [
    ("a < b and <c>", ["a < b and"]), ("x<!-- y", ["x"]), ("x<p", ["x"]), ("x <3 y", ["x <3 y"]),
    ("a<b>b</b>c", ["abc"]), ("a<p>b<div>c</p>d", ["a", "b", "c", "d"]), ("&amp;lt;", ["&lt;"]),
    ("<p>a&nbsp;b c</p>", ["a b c"]), ("<svg/>a<svg><text>b</text></svg>c", ["ac"]),
    ("<a title='>'>x</a>", ["x"]), ("<script>'</p>'</script>x", ["x"]), ("</>x</ y>z", ["</>x</ y>z"]),
    ("<noscript>a<p>b</noscript>c", ["c"]), ("<?xml x?><!x>y", ["y"]), ("&am &amp &#x41;", ["&am & A"]),
    ("<select><option>a</select>İ<script>x</SCRIPT>b", ["İb"]), ("", []), (" \n", []), ("<", ["<"]),
])
def test_blocks_of_odd_markup(source, want):
    assert [block.text for block in text_blocks(source)] == want


def test_links_and_neighbours_are_described():
    blocks = text_blocks("<nav><a href=x>a b</a></nav><article><p>c <a href=y>d</a> e f</article>g")
    assert [(b.words, b.link_words, b.in_main, b.beside) for b in blocks] == [
        (2, 2, False, True), (4, 1, True, False), (1, 0, False, False)]
    assert features(blocks)[1][3:9] == [4.0, 0.25, 2.0, 1.0, 1.0, 0.0]


def test_rows_of_pages(spark):
    prepared(spark)
    pages = [(k, f"u{k}", *page(k)) for k in range(0, 100, 10)]
    rows = [(i, u, h, 1, "clash", None) for i, u, h, _ in pages] * 2
    rows += [(None, None, None, 1, "", None), (7, None, "", 1, "", None)]
    out = main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted([(i, u, t, len(t)) for i, u, _, t in pages] * 2
                  + [(None, None, "", 0), (7, None, "", 0)], key=str)
    assert sorted(map(tuple, out), key=str) == want
    assert main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_and_hostile_pages_take_linear_time():
    tree, words = fitted(), prose(1, 200_000)
    assert main_text(f"<article><p>{words}</p></article>", tree) == words
    for piece in ("<a \"", "<div>", "<", "<!--", "</p>", "<svg>", "&", "<a href='"):
        text_blocks(piece * 100_000)


def test_given_pages_match_their_article(spark):
    """The given pages mark their article; cutting it out by pattern is the brute force."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", row.html)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert (got[row.page_id].text, got[row.page_id].n_chars) == (want, len(want))
