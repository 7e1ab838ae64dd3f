"""Pages: the text of a body, meta fields, and broken pages that no pattern may read again and again."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from orgwatch.functions import article, markup
from orgwatch.functions import text as T
from orgwatch.operators import extract

LONG = "Some words that are long enough to count as the text of a page. " * 4


@pytest.mark.parametrize("tag", sorted(markup.DROPPED))
def test_dropped_elements(tag):
    page = f"<html><head><title>head</title></head><body><p>{LONG}</p><{tag}>gone <b>too</b></{tag}><p>end</p></body></html>"
    assert markup.body_text(page) == LONG + "end"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav>menu</nav><p>short</p>", "menushort"),  # too little is left: only scripts and the like go
        ("<script>x</script><style>y</style><noscript>z</noscript><p>short</p>", "short"),
        (f"<nav>a<nav>b</nav>c</nav>{LONG}", LONG.strip()),
        (f"<div><nav>never closed</div>{LONG}", LONG.strip()),
        (f"<span><nav>a</span>b</nav>{LONG}", LONG.strip()),  # a stray end tag does not reach out of an element
        (f"<header>a<form>b</header>{LONG}", LONG.strip()),
        (f"<!-- <nav> -->{LONG}<!-- cut off", LONG.strip()),
        (f"<p title='a > b'>{LONG}</p>", LONG.strip()),
        (f"<script>if (a < b) '<nav>'</script>{LONG}", LONG.strip()),
        (f"<SCRIPT>x</Script >{LONG}", LONG.strip()),
        (f"{LONG}1 < 2 &amp; 3 &gt; 2&nbsp;!", f"{LONG}1 < 2 & 3 > 2 !"),
        (f"<title>t</title>{LONG}<svg><title>u</title></svg>", LONG.strip()),
        ("", ""),
        ("a <", "a <"),
        ("a <b", "a"),
    ],
)
def test_body_text(page, want):
    assert markup.body_text(page) == want


@pytest.mark.parametrize("said", ["&amp", "&ampmore", "&copy=1", "&#38", "&nosuch;"])
def test_references_end_in_a_semicolon(said):
    """What is cut off or unknown stays as it stands, in texts and in addresses."""
    assert markup.body_text(f"<p>{said}</p> &amp;amp &copy;") == f"{said} &amp ©"
    assert markup.links(f"<a href='/x?{said}'>{said}</a>") == [(f"/x?{said}", said)]


def test_page_text_column(spark):
    df = spark.createDataFrame([(f"<p>{LONG}</p>",), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(markup.page_text(F.col("html"), most=10)).collect()] == [LONG[:10], None, ""]


BROKEN = {
    "open": "<", "script": "<script ", "scripts": "<script>", "comment": "<!--", "title": "<title", "titles": "<title>", "anchor": "<a ", "anchors": '<a href="x">', "quoted": '<a href="x" ',
    "href": "href='a' ", "items": "<item>", "loc": "<loc>", "spaces": "<loc>" + " " * 40, "meta": "<meta ", "paragraphs": "<p>", "h3": "<h3><h3 ", "close": "</", "ends": "<div></x>", "nested": "<b><div>", "cdata": "<item><![CDATA[",
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_broken_pages_are_read_once(kind):
    """A megabyte without an end is read in seconds at most (squared, it would take hours)."""
    page = BROKEN[kind] * (1_000_000 // len(BROKEN[kind]))
    began = time.process_time()
    markup.body_text(page)
    article.read_article("https://a.org/", page, 120)
    assert time.process_time() - began < 12


def test_broken_pages_by_patterns(spark):
    """200,000 characters of each kind, with and without closing tags at the end, by every function on pages."""
    ends = "</a></p></item></loc></title></script>>"
    rows = [(f"https://a.org/{k}.xml", (v * (200_000 // len(v)))[:200_000] + end) for k, v in BROKEN.items() for end in ("", ends)]
    pages = spark.createDataFrame(rows, "url string, html string").cache()
    began = time.time()
    pages.select(T.visible_text(F.col("html")), extract.strip_tags(F.col("html")), T.page_title(F.col("html")), F.size(extract.news_links(F.col("html")))).collect()
    extract.article_details(pages).collect()
    extract.page_meta(pages).collect()
    for source in ("rss", "sitemap", "html"):
        extract.feed_articles(pages.select("url", F.lit(source).alias("source_type"), F.col("html").alias("text"))).count()
    assert time.time() - began < 240


def test_linear_patterns_find_what_plain_ones_do(spark):
    """On random pages of tags and pieces of tags the functions give what the plain patterns give."""
    draw = random.Random(1)
    parts = ["<script>", "</script>", "<style>", "</STYLE>", "<b>", "</b>", "<", ">", "x", " ", "<title>", "</title>", "\n", "<>"]
    pages = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: (r.v, r.s) for r in df.select("i", T.visible_text(F.col("html")).alias("v"), T.drop_tags(F.col("html")).alias("s")).collect()}
    for i, p in enumerate(pages):
        bare = re.sub(r"(?is)<style.*?</style>", " ", re.sub(r"(?is)<script.*?</script>", " ", p))
        assert got[i] == (re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", bare)).strip(" "), re.sub("<[^>]+>", " ", p))


def test_page_meta(spark):
    page = """<head><title> A
 page </title><meta name="description" content=""><META property='og:description' content='told &amp; kept'>
      <meta content="first" name="Description"><meta property="og:title" content="T"><meta property="og:title" content="U"><meta property="og:other" content="x"></head>"""
    rows = [("a", page), ("b", None), ("c", ""), ("d", "<meta name='description' content='cut")]
    got = {r.url: r for r in extract.page_meta(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["a"].title, got["a"].description, got["a"].descriptions) == ("A page", "first", "told & kept first")
    assert got["a"].og == {"og:title": "T", "og:description": "told & kept"}
    assert got["c"].title == "" and got["c"].description is None and got["c"].og == {} and got["d"].description is None and got["b"].title is None
