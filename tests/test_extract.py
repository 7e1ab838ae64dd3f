"""Extraction, matching and model exchange on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from orgwatch.functions import urls as U
from orgwatch.operators import extract, match, model_io

BASE = "https://www.example.edu/a/b/index.html?q=1"


@pytest.mark.parametrize(
    "href, want",
    [
        ("https://X.org/p#f", "https://x.org/p"), ("//cdn.x.org/p", "https://cdn.x.org/p"), ("/n", "https://www.example.edu/n"), ("c.html", "https://www.example.edu/a/b/c.html"),
        ("../c", "https://www.example.edu/a/c"), ("../../../c", "https://www.example.edu/c"), ("./", "https://www.example.edu/a/b/"), ("?r=2", "https://www.example.edu/a/b/index.html?r=2"),
        ("#top", "https://www.example.edu/a/b/index.html?q=1"), ("mailto:a@b.c", None), ("javascript:void(0)", None), ("x?y=/../z", "https://www.example.edu/a/b/x?y=/../z"),
    ],
)
def test_resolve_url(spark, href, want):
    assert spark.createDataFrame([(href, BASE)], "h string, b string").select(U.resolve_url(F.col("h"), F.col("b"))).first()[0] == want


HOME = """<html><head><link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="sitemap" href="/map.xml">
<meta name="generator" content="WordPress 6"></head><body><a href="/news/one">One</a><a href="https://other.org/news">Off</a><a href="/about">Über uns</a>
<a href="/x">新闻中心</a></body></html>"""


def test_news_endpoints(spark):
    df = spark.createDataFrame([("https://www.example.edu/", HOME), ("https://b.org/", "")], "url string, html string")
    got = {}
    for r in extract.news_endpoints(df, ["newsroom"]).orderBy("url", "rank").collect():
        got.setdefault(r.url, []).append((r.source_type, r.endpoint))
    site = "https://www.example.edu"
    assert got["https://www.example.edu/"] == [
        ("rss", f"{site}/feed.xml"), ("api", f"{site}/wp-json/wp/v2/posts?per_page=10"), ("sitemap", f"{site}/map.xml"), ("sitemap", f"{site}/sitemap.xml"),
        ("html", f"{site}/newsroom/"), ("html", f"{site}/news/one"), ("html", f"{site}/x"),
    ]
    assert got["https://b.org/"] == [("sitemap", "https://b.org/sitemap.xml"), ("html", "https://b.org/newsroom/")]
    first = extract.news_endpoints(df, prefer=["html"]).where("rank = 1 and url like '%example%'").first()
    assert first.source_type == "html"


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("rss", "<rss><item><title>A &amp; B</title><link>https://a.org/1</link></item><item><link>https://off.com/2</link></item></rss>", [("https://a.org/1", "A & B")]),
        ("rss", '<feed><entry><title><![CDATA[T]]></title><link href="/2"/></entry></feed>', [("https://a.org/2", "T")]),
        ("sitemap", "<urlset><url><loc> https://a.org/s </loc></url><url><loc>https://b.com/</loc></url></urlset>", [("https://a.org/s", "https://a.org/s")]),
        ("json", '{"items": [{"url": "https://news.a.org/j", "title": "J"}, {"url": "https://b.com"}]}', [("https://news.a.org/j", "J")]),
        ("api", '[{"link": "/p", "title": {"rendered": "P"}}]', [("https://a.org/p", "P")]),
        ("html", "<a href='/h'>H <b>x</b></a><a href='https://b.com/'>off</a>", [("https://a.org/h", "H x")]),
        ("json", "broken", []),
    ],
)
def test_feed_articles(spark, kind, text, want):
    df = spark.createDataFrame([("https://a.org/f", kind, text)], "url string, source_type string, text string")
    assert [(r.link, r.title) for r in extract.feed_articles(df).orderBy("pos").collect()] == want


def test_articles(spark):
    body = "<h2>Part</h2>" + "<p>Some words of a paragraph that is long enough.</p>" * 2 + "<p>Another one &amp; more words so that the body has its length.</p><ul><li>item</ul><img data-src='/i.png'>"
    ld = json.dumps({"headline": "LD title", "datePublished": "2026-01-02", "author": {"name": "Ann"}})
    rows = [
        ("https://a.org/1", f"<script type='application/ld+json'>{ld}</script><nav>x</nav><article>{body}</article>"),
        ("https://a.org/2", f"<script type='application/ld+json'>{{broken</script><title>Only title</title><meta name='author' content='Bo'><main>{body}</main>"),
        ("https://a.org/3", "<article><p>short</p></article>"),
    ]
    got = {r.url: r for r in extract.extract_articles(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert sorted(got) == ["https://a.org/1", "https://a.org/2"]
    one, two = got["https://a.org/1"], got["https://a.org/2"]
    assert (one.title, one.publish_time, one.author) == ("LD title", "2026-01-02", "Ann") and (two.title, two.author) == ("Only title", "Bo")
    assert [(c.type, c.content) for c in one.contents] == [
        ("text", "## Part"), ("text", "Some words of a paragraph that is long enough."), ("text", "Another one & more words so that the body has its length."),
        ("text", "• item"), ("image", "https://a.org/i.png"),
    ]


LONG = "<p>A paragraph with so many words that it alone is long enough for a body of an article, as the rules ask for a hundred and twenty characters.</p>"


@pytest.mark.parametrize(
    "url, page, method, platform",
    [
        ("https://mp.weixin.qq.com/s/x", f"<h1>H</h1><div id=js_content><div>{LONG}</div></div><main>{LONG * 3}</main>", "platform-rule", "wechat"),
        ("https://www.bbc.com/news/articles/c1", f"<h1>H</h1><article><div data-component='x'>no</div><div data-component='text-block'>{LONG}</div></article>", "platform-rule", "bbc"),
        ("https://edition.cnn.com/2026/01/02/a/b", f"<h1>H</h1><main>{LONG}</main>", "platform-rule", "cnn"),
        ("https://www.163.com/dy/article/1.html", f"<h1>H</h1><div class='a post_body'>{LONG}</div>", "platform-rule", "netease"),
        ("https://www.163.com/dy/article/2.html", f"<h1>H</h1><div class='entry-content'>{LONG}</div>", "generic-rule", "netease"),
        ("https://a.org/1", f"<h1>H</h1><main role='main'>{LONG}</main>", "generic-rule", None),
        ("https://a.org/2", f"<h1>H</h1><section itemprop='articleBody'>{LONG}</section>", "generic-rule", None),
        ("https://a.org/3", f"<h1>H</h1><div class='x article-body'><div><b>{LONG}</b></div></div><div>out<p>out</p></div>", "generic-rule", None),
        ("https://a.org/4", f"<h1>H</h1><div class='article-content'>{LONG}</div>", "generic-rule", None),
        ("https://a.org/5", f"<h1>H</h1><div class='post-content'>{LONG}</div>", "generic-rule", None),
        ("https://a.org/6", f"<h1>H</h1><div class='c-article-body__x'>{LONG}</div>", "generic-rule", None),
    ],
)
def test_body_rules(spark, url, page, method, platform):
    rows = extract.extract_articles(spark.createDataFrame([(url, page)], "url string, html string")).collect()
    assert [(r.url, r.title, r.method, r.platform, r.confidence, r.warnings) for r in rows] == [(url, "H", method, platform, 0.95 if method == "platform-rule" else 0.65, ["publish_time_not_found"])]
    assert [c.content for c in rows[0].contents] == [LONG[3:-4]]


def test_first_article_of_an_address(spark):
    """Of several pages of an address the first one counts, and a reference that is cut off in a title stays as it stands."""
    rows = [(f"https://a.org/{u}", f"<h1>{t}</h1><article>{LONG if whole else ''}</article>", n) for u, t, whole, n in [("1", "B", True, 2), ("1", "A &amp", True, 1), ("2", "C", False, 3), ("2", "D", True, 4)]]
    got = extract.first_articles(spark.createDataFrame(rows, "url string, html string, n long").repartition(3), "n").collect()
    assert [(r.url, r.title, r.n) for r in got] == [("https://a.org/1", "A &amp", 1)]


def test_article_items(spark):
    ld = json.dumps([{"@type": "Organization"}, {"headline": "T", "author": "Cy"}])
    body = f"<ul><li><p>in a list</p><li>two</ul>{LONG}<video><source src='/v.mp4'></video><iframe src='https://v.org/e#x'></iframe><img src='i.png' alt='An i'><noscript><p>off</p></noscript>{LONG}"
    page = f"<script type='application/ld+json'>{ld}</script><time datetime='2026-03-04'>4 March</time><div class='entry-content'>{body}</div>"
    r = extract.extract_articles(spark.createDataFrame([("https://a.org/d/1", page)], "url string, html string")).first()
    assert (r.title, r.author, r.publish_time, r.warnings) == ("T", "Cy", "2026-03-04", [])
    assert [tuple(c) for c in r.contents] == [
        ("text", "in a list", "in a list"), ("text", "• two", "two"), ("text", LONG[3:-4], LONG[3:-4]), ("video", "https://a.org/v.mp4", "/v.mp4"),
        ("video", "https://v.org/e", "https://v.org/e#x"), ("image", "https://a.org/d/i.png", "An i"),
    ]


def test_names(spark):
    text = "1. 清华大学；Work with the Royal Example Institute was done。一些公司, Acme Foundation"
    got = [r.name for r in extract.extract_names(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("pos").collect()]
    assert "Acme Foundation" in got and "Royal Example Institute" in got and "一些公司" not in got


ITEM = {"title": "T", "summary": "S", "url": "https://a.org/x", "relevance_score": 7}


@pytest.mark.parametrize(
    "answer, level",
    [
        (json.dumps([ITEM]), "direct"), (json.dumps(json.dumps([ITEM])), "direct"), (json.dumps({"candidates": [ITEM]}), "direct"), (json.dumps(ITEM), "direct"),
        (f"```json\n{json.dumps([ITEM])}\n```", "markdown"), (f"[FULL TEXT] found {json.dumps([ITEM])} ok]", "cleaned"), (f"so: {json.dumps([ITEM])[:-2]},}},] end", "repaired"),
        ("", "empty"), ("nothing", "failed"), (json.dumps([ITEM | {"extra": 1}]), "failed"), (json.dumps([ITEM | {"relevanceScore": 7}]), "failed"),
        (json.dumps([ITEM | {"relevance_score": 0}]), "failed"), (json.dumps([ITEM | {"relevance_score": 11}]), "failed"), (json.dumps([ITEM | {"relevance_score": 5.5}]), "failed"),
        (json.dumps([ITEM, ITEM | {"title": " "}]), "failed"), (json.dumps([ITEM | {"url": "no"}]), "failed"),
    ],
)
def test_parse_response(answer, level):
    got = model_io._parse(answer)
    assert got["level"] == level
    if level not in ("empty", "failed"):
        assert got["items"] == [ITEM | {"event_date": None, "event_type": None}]


def test_score_filter(spark):
    rows = [("o", "T", "S", "https://a.org/1", "2026-01-10", "policy", 5), ("o", "old", "S", "https://a.org/1", "2025-01-01", None, 5), ("o", "T2", "S", "https://a.org/2#f", "someday", "odd", 9), ("o", "T3", "cookie", "https://a.org/1", None, None, 9), ("o", "T4", "S", "https://a.org/9", None, None, 9), ("o", "T5", "S", "https://a.org/1", None, None, 3)]
    items = spark.createDataFrame(rows, "organization_id string, title string, summary string, url string, event_date string, event_type string, relevance_score int")
    cands = spark.createDataFrame([("o", "https://a.org/1", 1), ("o", "https://a.org/2", 2)], "organization_id string, url string, pos int")
    got = {r.title: r.event_type for r in model_io.score_filter(items, cands, "2026-01-20").collect()}
    assert got == {"T": "policy", "T2": "other"}


def test_homepage_evidence(spark):
    orgs = spark.createDataFrame([(1, "Example University", ["EU Lab"]), (2, "Other", None)], "entity_id int, name string, aliases array<string>")
    rows = [
        (1, "https://bar.com/", 200, "text/html", "<p>best bar in town</p>"), (1, "https://a.com/", 200, "text/html", "<p>Welcome to ExampleUniversity</p>"),
        (1, "https://example.edu/", 200, "", "<p>a university</p>"), (1, "https://b.com/", 404, "text/html", "Example University"), (1, "https://c.com/", 200, "application/pdf", "Example University"),
        (1, "https://blog.d.com/", 200, "text/html", "Example University"),
    ]
    got = {r.url: r.reason for r in match.verify_homepages(spark.createDataFrame(rows, "entity_id int, url string, status int, content_type string, html string"), orgs).collect()}
    assert list(got.values()) and got == {
        "https://bar.com/": "no_evidence", "https://a.com/": "evidence", "https://example.edu/": "host_and_marker", "https://b.com/": "http_status", "https://c.com/": "content_type", "https://blog.d.com/": "spam",
    }
    strict = match.identity_terms(orgs).where("entity_id = 1")
    for url, text, want in (("https://bar.com", "Example University", False), ("https://www.example.edu", "the Example University", True), ("https://www.example.edu", "bar", False)):
        assert strict.select(match.is_strict_candidate(F.lit(url), F.lit(text))).first()[0] is want


def test_decide_official(spark):
    orgs = spark.createDataFrame([(i,) for i in range(5)], "entity_id int")
    white = spark.createDataFrame([(0, "w.org")], "entity_id int, domain string")
    hits = spark.createDataFrame([(0, 1, "https://h.org", True), (1, 2, "https://b.org", True), (1, 1, "https://a.org", False), (2, 1, "https://u.org", False), (3, 1, "https://facebook.com/x", True)], "entity_id int, pos int, url string, accepted boolean")
    cached = spark.createDataFrame([(2, "c.org")], "entity_id int, domain string")
    got = {r.entity_id: (r.domain, r.status) for r in match.decide_official(orgs, white, hits, cached).collect()}
    assert got == {0: ("w.org", "whitelist"), 1: ("b.org", "verified"), 2: ("c.org", "cached"), 3: (None, "not_found"), 4: (None, "not_found")}


def test_names_from_tables(spark):
    said = [
        ("t", 0, 0, "学校名称"), ("t", 0, 1, "备注"), ("t", 1, 0, "清华大学、Alpha University"), ("t", 1, 1, "Beta University"), ("t", 2, 0, "由 the Gamma Institute 负责"),
        ("t", 2, 0, None), ("t", 3, 5, "Delta University"), ("u", 1, 0, "Epsilon University"),
    ]
    cells = spark.createDataFrame(said, "table_id string, row_no int, col_no int, text string")
    got = sorted((r.table_id, r.row_no, r.name) for r in extract.names_from_tables(cells).collect())
    assert got == [("t", 1, "Alpha University"), ("t", 1, "清华大学"), ("t", 2, "Gamma Institute")]
    assert extract.names_from_tables(cells.where("false")).count() == 0


def test_context_tokens(spark):
    df = spark.createDataFrame([("Alpha Lab", "The alpha lab studies optics, optics and p12 lasers. 收录于报告"), ("B", None)], "name string, summary string")
    assert [r.context for r in match.context_tokens(df).orderBy("name").collect()] == [["studies", "optics", "and", "lasers"], []]


def test_context_block(spark):
    from orgwatch.plans import cleaning

    rows = [("T", None, "a.org", "x" * 200), ("S", "2024", "a.org", "short")]
    got = [r.context_block for r in cleaning.context_block(spark.createDataFrame(rows, "title string, published string, domain string, body string"), 170).collect()]
    assert got == ["title: T\npublished_at: unknown\nsource_domain: a.org\nbody:\n" + "x" * 170, None]


def test_stopword_ratio(spark):
    from orgwatch.functions import text as T

    df = spark.createDataFrame([("the-of-cat-to-dog-a-b-c-d-e",), ("the cat sat on the mat by the door of it",), ("的" * 10 + "好" * 10,), (None,)], "c string")
    assert [r[0] for r in df.select(T.stopword_ratio(F.col("c"))).collect()] == [0.4, None, 0.5, None]


@pytest.mark.parametrize("said, want", [("2024-02-03 04:05:06", "2024-02-03 04:05"), ("2024-02-03", "2024-02-03 00:00"), (" Unknown ", "近期"), ("soon", "近期"), ("", "近期"), (None, "近期")])
def test_display_date(spark, said, want):
    from orgwatch.functions import dates as D

    assert spark.createDataFrame([(said,)], "c string").select(D.display_date(F.col("c"))).first()[0] == want
