"""News pages, search queries, kept candidates, order by locale."""

from pyspark.sql import functions as F

from orgwatch.operators import extract, match, topk


def test_news_page_by_kind(spark):
    """A page needs two article links, or one where it speaks of news; any other endpoint needs one item; else the homepage."""
    rows = [
        ("a", 1, "https://a.org/about", "html"), ("a", 2, "https://a.org/feed.xml", "rss"), ("b", 1, "https://b.org/x", "html"), ("b", 2, "https://b.org/news", "html"), ("c", 1, "https://c.org/map.xml", "sitemap"),
        ("d", 1, "https://d.org/x", "html"), ("e", 1, "https://e.org/x", "html"), ("f", 1, "https://f.org/never-fetched", "rss"),
    ]
    endpoints = spark.createDataFrame([(f"https://{u}.org/", r, e, k) for u, r, e, k in rows], "url string, rank int, endpoint string, source_type string")
    counts = [("https://a.org/about", 1, "About"), ("https://a.org/feed.xml", 1, None), ("https://b.org/x", 1, None), ("https://b.org/news", 1, None), ("https://c.org/map.xml", 0, None), ("https://c.org/", 2, None), ("https://d.org/x", 1, "最新 things"), ("https://e.org/x", 1, None), ("https://e.org/", 1, None)]
    got = {r.url[8]: r.news_page for r in extract.locate_news_page(endpoints, spark.createDataFrame(counts, "url string, n long, title string")).collect()}
    assert got == {"a": "https://a.org/feed.xml", "b": "https://b.org/news", "c": "https://c.org/", "d": "https://d.org/x", "e": None, "f": None}
    assert extract.locate_news_page(endpoints, spark.createDataFrame(counts, "url string, n long, title string").drop("title")).count() == 6


def test_article_links(spark):
    html = "".join(f'<a href="{h}">{t}</a>' for h, t in [
        ("/news/one", "A long title"), ("/news/one#top", "A long title"), ("/a/b", "Partner found here"), ("/a/b/c", "nothing to see"), ("/news", "A long title"), ("/news/two", "short"), ("http://a.org/news/3", "A long title"), ("https://x.org/news/4", "A long title"),
    ])
    pages = spark.createDataFrame([("https://www.a.org/", html), ("https://b.org/", None)], "url string, html string")
    assert {r.url: r.n for r in extract.article_link_count(pages).collect()} == {"https://www.a.org/": 2, "https://b.org/": 0}


def test_official_site_query(spark):
    rows = [
        ("1", "Alpha Lab （阿尔法）", "高校", "university", "Berlin", "DE", ["one", "二", "two", "three", "four"]), ("2", "某大学", "高校", "university", "未标注", "北京", ["词"]),
        ("3", "Jane Doe", "人物", None, "T12", None, None), ("4", "X1", "公司", "odd", None, "", []),
    ]
    df = spark.createDataFrame(rows, "entity_id string, name string, entity_type string, route_kind string, city string, region string, context array<string>")
    got = {r.entity_id: r.query for r in match.official_site_query(df).collect()}
    assert got["1"] == "Alpha Lab one two three Berlin official website research news technology transfer" and got["2"] == "某大学 词 北京 官网"
    assert got["3"] == "Jane Doe official profile" and got["4"] == "X1 official website news press release"


def test_official_site_query_of_a_name_with_a_number(spark):
    rows = [("1", "Maker#000001900 （甲）", "公司"), ("2", "测试大学2001", "高校"), ("3", "Some Lab, 2024", "公司")]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "entity_id string, name string, entity_type string, route_kind string, city string, region string, context array<string>")
    got = {r.entity_id: r.query for r in match.official_site_query(df).collect()}
    assert got == {"1": "Maker#000001900 official website news press release", "2": "测试大学2001 官网", "3": "Some Lab official website news press release"}


def test_wiki_title_of_a_name_with_a_number(spark):
    """A number at the end of a name stays part of it, even where its last four digits look like a year."""
    schema = "entity_id int, name string, website_url string, context array<string>, entity_type string"
    entities = spark.createDataFrame([(1, "Maker#000001900", "", ["lab"], "高校"), (2, "Some Lab (SL), 2024", "", ["lab"], "高校")], schema)
    sites = [("Maker#000001900", "| website = https://m.org/"), ("Maker#00000", "| website = https://no.org/"), ("Some_Lab", "| website = https://s.org/")]
    pages = spark.createDataFrame(sites, "title string, wikitext string")
    none = spark.createDataFrame([], "from string, to string")
    assert {r.entity_id: r.url for r in match.match_wiki(entities, pages, none).collect()} == {1: "https://m.org/", 2: "https://s.org/"}


def test_candidates_are_kept(spark):
    orgs = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    hits = spark.createDataFrame([("a", i, f"https://s{i % 10}.org/", False) for i in range(20)] + [("b", 1, "https://b.org/", True), ("a", 99, None, False)], "entity_id string, pos int, url string, accepted boolean")
    none = spark.createDataFrame([("b", "b.edu")], "entity_id string, domain string")
    got = {r.entity_id: (r.status, r.candidates) for r in match.decide_official(orgs, none, hits, none.where("false")).collect()}
    assert got == {"a": ("unverified", [f"https://s{i}.org/" for i in range(8)]), "b": ("whitelist", []), "c": ("not_found", [])}


def test_order_by_locale(spark):
    names = ["b", "B", "á", "a", "A", "ab", "z", "Ä", "é", "e", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    assert [r.name for r in topk.sort_names(df, "name", "UNICODE").collect()] == ["a", "A", "á", "Ä", "ab", "b", "B", "e", "é", "z", "Z"]
    assert [r.name for r in topk.sort_names(df, "name").collect()][:4] == ["A", "a", "ab", "B"]
    assert topk.sort_names(df.select(F.col("name").alias("n")), "n", "zh").count() == len(names)
