from __future__ import annotations

import html
import os
import re
from collections import Counter

import pytest

from stratalog.llm.html_extract import extract_pages, main_text

PARAGRAPH = "This is the text of the article and it has enough of the words that are in all of the texts to be one of them."
SECOND = "And here is another one, which is as long as the first of them was, so that it is decided by itself as well."

CASES = {
    "article with everything around": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
        f"<div class='cookie-notice'>{PARAGRAPH}</div><aside>{PARAGRAPH}</aside><article><h1>Title</h1><p>{PARAGRAPH}<br>{SECOND}</p><form><p>{SECOND}</p><button>Go</button></form>"
        f"<div class=ad>{SECOND}</div><p>Short.</p><section id='comments'><article><p>{SECOND}</p></article></section></article><footer>&copy; {PARAGRAPH}</footer></body></html>",
        f"Title {PARAGRAPH} {SECOND} Short.",
    ),
    "no article: density decides": (
        f"<body><div class='menu'><a href=1>Home</a></div><div><h2>Head</h2><p>{PARAGRAPH}</p><p>Between.</p><p>{SECOND}</p><p><a href=x>Link</a> <a href=y>list of many links</a></p></div><div id='sidebar'>{PARAGRAPH}</div></body>",
        f"Head {PARAGRAPH} Between. {SECOND}",
    ),
    "references, white space, inline": (f"<main><p>a&amp;b &lt;tag&gt;   &#x41;&#66;\n\t<b>bo</b>ld &eacute;&nbsp;x &copy 1</p><p>{PARAGRAPH}</p></main>", f"a&b <tag> AB bold é x © 1 {PARAGRAPH}"),
    "tables and lists of an article stay": (
        "<article><table><tr><td>alpha<td>beta</tr></table><ul><li>gamma<li>delta</ul><p>one | two | three | four | five | six | seven | eight | nine | ten | eleven</p></article>",
        "alpha beta gamma delta one | two | three | four | five | six | seven | eight | nine | ten | eleven",
    ),
    "broken markup": (f"<article><p>{PARAGRAPH}<p><b>Open &am", f"{PARAGRAPH} Open &am"),
    "cut in a tag": (f"<article><p>{PARAGRAPH}</p><p cla", PARAGRAPH),
    "unclosed quote": (f"<article><p title=\"x>{PARAGRAPH}</p></article>", PARAGRAPH),
    "less-than in text": ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    "text alone": ("just text", "just text"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_unclosed_quotes_cost_linear_time():
    assert main_text('<p a="' * 20_000) == ""
    assert len(main_text("<div><b>" * 5_000 + "deep")) == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.DOTALL)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner[1])).split()) if inner else ""
        assert r["text"] == want and r["n_chars"] == len(want)


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "u", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("", 0), ("x", 1)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def without_structure(page: str) -> str:
    """The page with all its elements that say what a part is for renamed, and without class names, ids and roles."""
    page = re.sub(r"<(/?)(article|nav|aside|footer|header|main|section|form|button|dialog|menu|select)\b", r"<\1div", page, flags=re.IGNORECASE)
    return re.sub(r"""\s(class|id|role|hidden|itemprop|aria-hidden|style)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_rules_carry_pages_without_structure(spark):
    """Of pages whose markup says nothing, the rules of length, links and stop words keep 97 words of 100 and add hardly any."""
    want, got, same, pages = Counter(), Counter(), 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        a, b = main_text(r["html"] or ""), main_text(without_structure(r["html"] or ""))
        want.update((r["page_id"], w) for w in a.split())
        got.update((r["page_id"], w) for w in b.split())
        same, pages = same + (a == b), pages + 1
    assert same >= 0.75 * pages
    assert (want - got).total() <= 0.03 * want.total() and (got - want).total() <= 0.005 * want.total()


def test_deep_and_very_long_pages():
    deep = "<div>" * 3_000 + f"<article><p>{PARAGRAPH}</p></article>" + "</div>" * 3_000 + f"<div class=ad>{SECOND}</div><p>{SECOND}</p>"
    assert main_text(deep) == PARAGRAPH
    many = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{many}</article><footer>{SECOND}</footer>") == " ".join(f"{PARAGRAPH} {i}" for i in range(20_000))
    assert len(main_text("<p><div>" + "<b>" * 100_000 + "<li>x" * 1_000).split()) == 1_000
