"""Wrappers: hosts of copies and near-copies, unmarked pages, articles over siblings, names, broken and very long pages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from codequarry.llm import html_wrapper


def page(story: str, advert: str = "one") -> str:
    return f"<body><div class=top><b>Our site</b></div><div class=x><p>{story}</p></div><div class=y><p>{advert}</p></div><div class=bottom>All rights</div></body>"


def drawn(spark, pages: list[str]) -> list[str]:
    """``pages`` in the order in which pivots are taken."""
    return [r.html for r in spark.createDataFrame([(p,) for p in pages], "html string").orderBy(F.xxhash64("html", F.lit(11))).collect()]


def texts_of(spark, rows: list[tuple[str, str]]) -> list[str]:
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_wrapper.main_text(frame).collect())]


def test_copies_and_near_copies_do_not_fill_the_pivots(spark):
    ordered = drawn(spark, [page(f"Story {k}", f"advert {k}") for k in range(6)])
    rows = [("http://copies/", p) for p in [ordered[0]] * 5 + ordered[1:]]
    near = drawn(spark, [page("Same story", f"advert {k}") for k in range(40)])[:4]
    later = [p for p in drawn(spark, near + [page(f"Other {k}", f"advert {k}") for k in range(40)])]
    rows += [("http://near/", p) for p in later if p in near or later.index(p) > later.index(near[-1])]
    texts = texts_of(spark, rows)
    assert len(texts) == len(rows) and not any("Our site" in t or "All rights" in t for t in texts)
    assert sum("Same story" in t for t in texts) == 4


UNMARKED = "<body><div>The Daily</div><div><ul><li><a href=1>%s</a></li><li><a href=2>more</a></li><li><a href=3>last</a></li></ul></div><div><h2>%s</h2><p>%s</p><p>end %s</p></div><div>Imprint</div></body>"


def test_unmarked_pages(spark):
    rows = [("http://plain/", UNMARKED % (f"menu {k}", f"Head {k}", "word " * (k + 20), k)) for k in range(6)]
    assert texts_of(spark, rows) == [f"Head {k}\n{('word ' * (k + 20)).strip()}\nend {k}" for k in range(6)]


def test_an_unmarked_advert_goes_with_its_slot():
    pages = [f"<body><div class=ad>Buy {k}</div><div class=story><p>Story {k}</p><p>Text {k}</p></div></body>" for k in range(6)]
    bare = "<body><div>Buy me</div><div class=story><p>Story x</p><p>Text x</p></div></body>"
    assert html_wrapper.extract(bare) == "Buy me\nStory x\nText x"
    assert html_wrapper.judged(bare, html_wrapper.induce([*pages, bare])) == ("Story x\nText x", 1)


def test_articles_over_siblings_and_teasers():
    split = "<body><nav>Menu</nav><article><p>One %s</p></article><article><p>Two %s</p></article><div><p>Three %s</p></div><footer>F</footer></body>"
    pages = [split % (k, k, k) for k in range(4)]
    for wrapper in (None, html_wrapper.induce(pages)):
        assert [html_wrapper.extract(p, wrapper) for p in pages] == [f"One {k}\nTwo {k}\nThree {k}" for k in range(4)]
    assert html_wrapper.extract("<article>Teaser</article><div><p>Long body</p></div>") == "Teaser\nLong body"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><div class="social-history">A</div><section id="reply-theory">B</section><div class="notice">C</div></article>', "A\nB\nC"),
        ('<div class="cookie-notice">x</div><div class="social-history">A</div><div id="site-header">y</div><div class="ad">z</div>', "A"),
        ('<article><header><h1>T</h1></header>A<aside>x</aside><footer>y</footer><div id="comments"><article>z</article></div></article>', "T\nA"),
        ("<form id=aspnet><header>x</header><article>A<form>y</form></article></form>", "A"),
        ('<div class="sidebar"><main>A</main></div><div class="sidebar">x</div>', "A"),
        ("<div hidden>x</div><div style='display : none'>y</div><div role=banner>z</div>A", "A"),
        ("a < b <c d=\"e>f\">g</c> <a href='x>y' title=\"p\">h</a> &lt;i&gt; <b", "a < b g h <i> <b"),
        ('A<a b="c>d', 'Ad'),
        ("A<!-- <p>x</p> --><![CDATA[<y>]]><?z?><!doctype q>B<!-- open", "A<y>B"),
    ],
)
def test_marks_and_broken_markup(html, text):
    assert html_wrapper.extract(html) == text


def test_text_shared_within_articles_stays():
    pages = [f"<body><div>Site</div><article><p>Shared licence text.</p><p>Own {k}</p></article></body>" for k in range(5)]
    wrapper = html_wrapper.induce(pages)
    assert [html_wrapper.judged(p, wrapper) for p in pages] == [(f"Shared licence text.\nOwn {k}", 1) for k in range(5)]
    assert html_wrapper.extract("<body><div>Site</div></body>", wrapper) == "Site"  # nothing but template: the page keeps it


def test_names_within_articles_need_the_wrapper():
    pages = [f"<article><p>Text {k}</p><div class=share>Share {k}</div></article>" for k in range(5)]
    assert html_wrapper.extract(pages[0]) == "Text 0\nShare 0"
    assert html_wrapper.extract(pages[0], html_wrapper.induce(pages)) == "Text 0"


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<a b='>", "<a", "<", '<a b=">" ', "<!--", "<p x=", "</", "<div class=c>t", '="', "<td><b>x"])
def test_long_broken_pages_take_linear_time(unit):
    began = time.perf_counter()
    html_wrapper.extract(unit * 100_000 + ">")
    html_wrapper.extract(unit * 100_000)
    assert time.perf_counter() - began < 10


def test_wide_and_deep_pages_align():
    wide = ["<body>" + "".join(f"<div class=c{j % 3000}>{k} {j}</div><section>s</section>" for j in range(6000)) + "</body>" for k in range(2)]
    began = time.perf_counter()
    wrapper = html_wrapper.induce(wide)
    assert html_wrapper.extract(wide[0], wrapper).startswith("0 0\n") and time.perf_counter() - began < 30
    deep = ["<div>" * 5000 + f"t{k}" for k in range(2)]
    assert html_wrapper.extract(deep[1], html_wrapper.induce(deep)) == "t1"


def test_joined_wrappers_say_the_same(spark, monkeypatch):
    rows = [(f"http://h{k % 3}/", UNMARKED % (k, k, f"w{k} " * 9, k)) for k in range(30)] + [("http://h1/", None), (None, "<p>x"), ("http://single/", "<p>y")]
    shared = texts_of(spark, rows)
    monkeypatch.setattr(html_wrapper, "BROADCAST_CHARS", 0)
    assert texts_of(spark, rows) == shared and shared[-3:] == ["", "x", "y"]


def test_registered_query_against_plain_reading(spark, sf_dir):
    """The pages of the given tables have one article each, of headings, paragraphs and lines."""
    import html
    import re

    import pandas as pd

    from codequarry.llm import queries

    given = pd.read_parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in queries.op5_html_extract(spark, sf_dir).collect()}
    assert len(found) == len(given)
    for row in given.itertuples():
        article = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[row.page_id].text == "\n".join(b for b in blocks if b)
    # the wrapper judged pages of every host that has two different ones
    hosts = given.assign(host=given.url.str.extract(r"://([^/?#]*)")[0]).groupby("host").html.nunique()
    many = set(hosts[hosts > 1].index)
    assert {p for p, r in found.items() if r.wrapped} == {row.page_id for row in given.itertuples() if re.search(r"://([^/?#]*)", row.url)[1] in many}
