import re
from html import unescape

import pytest

from iolens.llm import html_tree as H


def text(html):
    return H.main_text(H.Page(html), {})


CASES = {
    "": "",
    "just text": "just text",
    "<p>a  b\n c</p>\n<p>d</p>": "a b c\nd",
    "<p><b>unclosed<br><p>next": "unclosed\nnext",
    "x &amp;lt;&nbsp;&copy;&#233; &eacute y": "x &lt; ©é é y",
    "<nav>m</nav><header>h</header><p>t</p><aside>s</aside><footer>f</footer><form>q<input></form>": "t",
    "<div class='side-bar sidebar'>s</div><div id=cookieNotice>n</div><div class=ad-slot>a</div><p>t": "t",
    "<p>a <span class=ad>buy</span>b<script>if(1<2){'</p>'}</script>c</p>": "a bc",
    "<article><header><h1>T</h1></header><p>a<div class=comments><p>c</div><p>b</article><p>outside": "T\na\nb",
    "<body class='has-sidebar'><main class='main-menu'><p>x</main></body>": "x",
    "<form><article><p>t</article><input></form>": "t",
    "<div hidden>h</div><div style='display: none'>n</div><div role=banner>r</div><p>t": "t",
    "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>": "a\nb\nc\n1\n2\n3",
    "<p>a<!-- <p>no</p> --><i>b</I></p><!DOCTYPE x><?php y ?>z": "ab\nz",
    "<<p>a < b > c": "<\na < b > c",
    "<a href='>'>q</a> <img alt=\"x>y\">r": "q r",
    "<p>end <a href=\"open": "end <a href=\"open",
    "<style>p{}</style><title>t</title><textarea><p>x</textarea>y": "y",
    "<script>never ends <p>x": "",
    "<article class='comment'>c</article><article>a</article>": "a",
    "<h2 class='notice'>Head</h2><p>t": "Head\nt",
}


@pytest.mark.parametrize("html", CASES)
def test_main_text(html):
    assert text(html) == CASES[html]


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert text("<p>" + "word " * 100_000) == ("word " * 100_000).strip()
    assert text("<a " + "x='" * 2000) == "<a " + "x='" * 2000


def test_pages_table(spark, sf):
    """The pages mark their article; all of its blocks come out, and nothing else."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.url, r.text) for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == (r.url, "\n".join(p for p in parts if p))


def site(spark):
    """Pages that say nothing about themselves: what all of a host's pages share is no content."""
    rows = [
        (i, f"http://{'news.example' if i % 3 else 'Other.example'}/{i}",
         f"<div><div>Home About Contact</div><div><p>Story {i}</p><p>More of {i * i}</p></div><div>Made by us</div></div>")
        for i in range(40)
    ]
    rows += [(100, "http://news.example/x", None), (101, None, "<div>Home About Contact</div>"), (102, "http://lone.example", "<div>Made by us</div>")]
    rows += [(103, "http://news.example/y", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as host", "1 as c")


WANTED = {i: f"Story {i}\nMore of {i * i}" for i in range(40)} | {100: "", 101: "Home About Contact", 102: "Made by us", 103: ""}


def test_what_a_site_repeats_is_removed(spark):
    assert {r.page_id: r.text for r in H.extract(site(spark)).collect()} == WANTED


def test_scores_by_join_are_the_same(spark):
    pages = site(spark).union(site(spark).where("page_id = 5"))
    got = sorted((r.page_id, r.text) for r in H.extract(pages, max_broadcast=0).collect())
    assert got == sorted([*WANTED.items(), (5, WANTED[5])])


def test_few_or_equal_pages_keep_their_text(spark):
    rows = [(i, "http://a.example/", "<div>same</div>") for i in range(H.MIN_PAGES - 1)]
    rows += [(50 + i, "http://b.example/", "<article><p>same copy</p></article><div>foot</div>") for i in range(60)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got if r.page_id < 50} == {"same"}
    assert {r.text for r in got if r.page_id >= 50} == {"same copy"}
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_scores_are_entropies(spark):
    """The mean score of a node over its pages is its normalised entropy."""
    from math import log

    counts = {"a": 6, "b": 3, "c": 1}
    m = sum(counts.values())
    mean = sum(c / m * log(m / c) / log(m) for c in counts.values())
    assert mean == pytest.approx(-sum(c / m * log(c / m, m) for c in counts.values()))


def test_article_inside_a_named_wrapper():
    assert text("<div class='page has-sidebar'><article><p>t</article><p>n</div><div class=menu>m</div>") == "t"
    assert text("<div class=comments><article>c</article></div><nav><article>m</article></nav><article>a</article>") == "a"


def test_what_a_site_repeats_inside_articles_is_removed(spark):
    rows = [
        (i, f"http://a.example/{i}", f"<article><h1>Head {i}</h1><div class=x><p>Follow us</p></div><p>Story {i}</p></article>")
        for i in range(40)
    ]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Head {i}\nStory {i}" for i in range(40)}
