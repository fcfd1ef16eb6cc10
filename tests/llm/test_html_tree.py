"""HTML extraction: what belongs to the article, odd tables through Spark, and time linear in the page."""

from __future__ import annotations

import time

import pytest

from vitalgauge.llm.html_text import extract, extract_text

LINKS = "<ul><li><a href=1>One source</a></li><li><a href=2>Two sources</a></li><li><a href=3>Three sources</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><header><h1>Title</h1></header><p>Some text, here.</p></article>", "Title\nSome text, here."),
        ("<header><h1>Site</h1></header><article><p>Some text, here.</p></article>", "Some text, here."),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>Some text, here.</p></article>", "Title\nSome text, here."),
        (f"<article><p>Some text, here.</p>{LINKS}</article>", "Some text, here.\nOne source\nTwo sources\nThree sources"),
        (f"<nav>{LINKS}</nav><article><p>Some text, here.</p></article>", "Some text, here."),
        (f"<article><nav>{LINKS}</nav><p>Some text, here.</p><footer>By</footer></article>", "Some text, here."),
        ("<article><p>See <span class='text-sharing-notice'>this</span>, ok.</p></article>", "See this, ok."),
        ("<article><p>See this, ok.<span class='ad'>Buy</span></p><div class='share-box'>Tell</div></article>", "See this, ok."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", "Let x=1 be."),
        ("<article><p>One &amp; two&nbsp;&#x41;<br>and  \n three<p>Four</i></b>, five", "One & two A and three\nFour, five"),
        ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", "a\nb\nc"),
        ("", ""),
        ("<p></p>", ""),
        ("no markup", "no markup"),
    ],
)
def test_parts_of_a_page(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<p>x" + "<b>" * n + "</i>" * n,
        lambda n: "<b>" * n + "<p>x</p>" * n,
        lambda n: "<ul>" + "<b>" * n + "<li>x</li>" * n,
        lambda n: "<li><ul>" + "<b>" * n + "<li>x</li>" * n,
        lambda n: "<div>" * n + "<p>x, y</p>" * n,
        lambda n: "<div><a href=1>a</a>" * n,
        lambda n: "<center>" * n + "<p>x",
        lambda n: "<a " + "b" * n + ">x</a>",
    ],
)
def test_time_is_linear_in_the_page(make):
    def took(n):
        start = time.process_time()
        extract(make(n))
        return time.process_time() - start

    assert took(80_000) < 8 * max(took(20_000), 0.25)


def test_odd_tables(spark):
    rows = [(1, "u", "<article><p>Text, one.</p></article>", "x")] * 2 + [
        (2, None, None, None), (3, "u", "", "y"), (None, "u", "<p>Only, this.</p>", "z"), (4, "u", "<p>" + "word, " * 50_000, "q")
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(pages, out="text").collect()
    assert len(got) == 6 and [r.text for r in got[:5]] == ["Text, one.", "Text, one.", "", "", "Only, this."]
    assert got[5].text == " ".join(("word, " * 50_000).split())
    assert extract_text(pages, out="other").columns == ["page_id", "url", "html", "text", "other"]
    assert extract_text(pages.limit(0)).count() == 0
