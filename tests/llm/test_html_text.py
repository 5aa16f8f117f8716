import html
import re

from pyspark.sql import types as T

from argosift.llm import html_text as H


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


LONG = "This is a sentence of the article that says something of interest to its readers. " * 3


def test_given_pages_match_their_article_element(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" in b else "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("</b>", ""))]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_boilerplate_goes_and_short_blocks_stay():
    text = H.main_text(page(
        '<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav>'
        '<div class="cookie-notice">We use cookies. ' + LONG + '</div><aside>' + LONG + '</aside>'
        f'<article><header><h1>Head &amp; line</h1></header><p>{LONG}</p><p>Short.</p>'
        f'<div class="ad"><p>Buy now</p><div>{LONG}</div></div><p>a<br>b &lt;i&gt; &#228;&nbsp;c</p>'
        '<form><input name="q"><p>Search</p></form><script>var a = "</p><p>no";</script>'
        f'<ul><li>First point</li><li><b>Second</b> point</li></ul><p>{LONG}</p></article>'
        f'<section id="comments"><article class="comment"><p>{LONG}{LONG}{LONG}{LONG}</p></article></section>'
        '<footer>&copy; me</footer><!-- <p>hidden</p> -->'))
    one = LONG.strip()
    assert text == "\n\n".join(["Head & line", one, "Short.", "a b <i> ä c", "First point", "Second point", one])


def test_page_without_article_element():
    text = H.main_text(page(
        '<div id="menu"><a href="a">One</a></div><table><tr><td><a href="b">Two</a> <a href="c">Three</a></td></tr></table>'
        f'<div><h2>Title</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div class="footer">x</div>'))
    assert text == f"Title\n\n{LONG.strip()}\n\nTiny.\n\n{LONG.strip()}"


def test_wrappers_around_the_article():
    article = f"<article><h1>Head</h1><p>{LONG}</p></article>"
    want = f"Head\n\n{LONG.strip()}"
    assert H.main_text(page(f'<form id="page">{article}<input></form>')) == want
    assert H.main_text(page(f'<div class="has-sidebar">{article}<div class="sidebar">{LONG}</div></div>')) == want
    assert H.main_text(page(f'<nav><ul><li>never closed{article}')) == want
    assert H.main_text(page(f'{article}<div style="display: none">{LONG}</div><p hidden>{LONG}</p>')) == want


def test_article_inside_an_excluded_wrapper():
    one = LONG.strip()
    article = f"<article><h1>Head</h1><p>{LONG}</p></article>"
    want = f"Head\n\n{one}"
    assert H.main_text(page(f'<div class="content-sidebar-wrap"><main>{article}</main><div>Other</div></div>')) == want
    assert H.main_text(page(f'<div id="widget"><div>{article}</div>{LONG}{LONG}{LONG}</div><p>After</p>')) == want
    # Articles of comments, related items and hidden blocks, and teasers beside plain text, stay outside.
    for kind in ('class="comments"', 'id="related"', "hidden"):
        assert H.main_text(page(f"<div><p>{LONG}</p></div><div {kind}><article>{LONG}{LONG}</article></div>")) == one
    assert H.main_text(page(f'<div><p>{LONG}</p></div><div class="sidebar"><article>Teaser</article></div>')) == one
    assert H.main_text(page(f"<div><p>{LONG}</p></div><aside><article>{LONG}{LONG}</article></aside>")) == one


def test_nested_and_sibling_articles():
    one = LONG.strip()
    assert H.main_text(page(f"<main><h1>Head</h1><article><p>{LONG}</p></article><p>After</p></main>")) == (
        f"Head\n\n{one}\n\nAfter")
    assert H.main_text(page(f"<div><article><p>Part one</p></article><article><p>{LONG}</p></article></div>")) == (
        f"Part one\n\n{one}")
    assert H.main_text(page(f"<article><p>{LONG}</p><article><p>Inner</p></article><p>End</p></article>")) == (
        f"{one}\n\nInner\n\nEnd")


def test_short_regions_between_excluded_elements():
    one = LONG.strip()
    ad = '<div class="ad">Buy</div>'
    assert H.main_text(page(f"<div><p>Lead</p>{ad}<p>{LONG}</p>{ad}<p>Short.</p>{ad}<p>{LONG}</p>{ad}<p>End</p></div>")) == (
        f"Lead\n\n{one}\n\nShort.\n\n{one}\n\nEnd")


def test_odd_markup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<div></div>") == ""
    assert H.main_text("plain  text\n here") == "plain text here"
    assert H.main_text("a < b and c > d") == "a < b and c > d"
    assert H.main_text("<p>one<p>two<p>three") == "one\n\ntwo\n\nthree"
    assert H.main_text('<p title="a > b">x</p><p title=\'<p>\'>y</p>') == "x\n\ny"
    assert H.main_text("<p>x<script>never closed <p>y") == "x"
    assert H.main_text("<p>x</p><nav>never closed <p>y") == "x"
    assert H.main_text("<P>Upper</P><BR/><STYLE>p{}</STYLE>") == "Upper"
    assert H.main_text("<p>emoji 🙂 &#128578; &amp;amp;</p>") == "emoji 🙂 🙂 &amp;"
    assert len(H.main_text("<p>" + "word " * 300_000 + "</p>")) == 1_499_999
    assert H.main_text("<p>" + "<" * 50_000) is not None
    assert H.main_text("<p " + 'a="b' * 20_000) is not None


def test_table_edge_cases(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (2, "u", "<p>b</p>", "z"), (2, "u", "<p>b</p>", "z")]
    got = sorted((tuple(r) for r in H.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "a", 1), (2, "u", "b", 1), (2, "u", "b", 1)], key=str)
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
