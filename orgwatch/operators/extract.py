"""Links, articles and names out of pages, feeds and texts. By patterns inside expressions: a page is a row, what is found
in it becomes rows by ``explode``. Only whole articles are read in Python, by batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import article as A
from ..functions import text as T
from ..functions import urls as U

#: Fixed patterns and words. A tag's pattern stops at the next < or >, and what is looked for between two tags is looked for
#: up to the last closing one (``T.up_to_last``), so that each pattern reads a page once, however broken it is.
ANCHOR = r"""(?is)<a\b(?>[^<>]*?\bhref\s*+=\s*+["']([^"'<>]+)["'])[^<>]*+>(.*?)</a>"""
LINK_TAG = r"(?is)<link\b[^<>]*>"
NEWS_WORDS = r"(?i)news|press|event|公告|新闻|动态"
ITEM = r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"
SOURCE_TYPES = ["rss", "json", "api", "sitemap", "html"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
ENGLISH_SUFFIXES = [
    "University", "Institute", "Laboratory", "Foundation", "Association", "Center", "Centre", "College", "Academy", "Society", "Corporation", "Company",
    "Group", "Bank", "Hospital", "Ministry", "Department", "Commission", "Agency", "Council",
]
CHINESE_SUFFIXES = ["大学", "学院", "研究院", "研究所", "实验室", "中心", "基金会", "协会", "学会", "联盟", "公司", "集团", "银行", "医院"]
SEPARATORS = r"[\n\r\t,，;；、|。！？:：()（）\[\]【】]+"


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)


def decode_entities(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_tags(c: Column) -> Column:
    return T.collapse_ws(decode_entities(T.drop_tags(c)))


def anchors(html: Column) -> Column:
    """The anchors of a page as they stand, in order."""
    return F.regexp_extract_all(T.up_to_last(html, "</a>"), F.lit(ANCHOR), F.lit(0))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page key columns, pos, href, link, text) for each anchor with an address that can be resolved."""
    rest = [c for c in pages.columns if c != html]
    found = pages.select(*rest, F.posexplode(anchors(F.col(html))).alias("pos", "_a"))
    href = decode_entities(F.regexp_extract("_a", ANCHOR, 1))
    made = found.select(*rest, "pos", href.alias("href"), strip_tags(F.regexp_extract("_a", ANCHOR, 2)).alias("text"))
    return made.withColumn("link", U.resolve_url(F.col("href"), F.col(url))).where("link is not null")


def _same_site(a: Column, b: Column) -> Column:
    return U.site_key(U.host(a)) == U.site_key(U.host(b))


def news_endpoints(pages: DataFrame, hints: list[str] | None = None, prefer: list[str] | None = None) -> DataFrame:
    """(url, rank, endpoint, source_type) of each homepage: alternates, sitemaps, the posts of a known generator, hinted paths
    and links that look like news, on the same site, once each, by preference of type and then in order of finding."""
    prefer = prefer or SOURCE_TYPES
    tags = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0))).alias("pos", "t"))
    rel, kind, href = F.lower(attribute(F.col("t"), "rel")), F.lower(attribute(F.col("t"), "type")), attribute(F.col("t"), "href")
    typed = F.when(rel.contains("sitemap"), "sitemap").when(kind.rlike("rss|atom") | href.endswith(".xml"), "rss").when(kind.contains("json"), "json")
    parts = [tags.where(rel.rlike("alternate|sitemap") & (href != "")).select("url", F.lit(0).alias("step"), "pos", href.alias("href"), typed.alias("source_type"))]
    generator = r"""(?i)name=["']generator["'].*content=["'][^"']*WordPress"""
    press = pages.where(F.exists(meta_tags(F.col("html")), lambda m: m.rlike(f"(?s){generator}")))
    fixed = lambda df, step, h, k: df.select("url", F.lit(step).alias("step"), F.lit(0).alias("pos"), F.lit(h).alias("href"), F.lit(k).alias("source_type"))
    parts.append(fixed(press, 1, "/wp-json/wp/v2/posts?per_page=10", "api"))
    parts += [fixed(pages, 2 + i, h.lstrip("/").rstrip("/") + "/", "html") for i, h in enumerate(hints or [])]
    news = page_links(pages.select("url", "html")).where(F.concat_ws(" ", "href", "text").rlike(NEWS_WORDS))
    parts.append(news.select("url", F.lit(1000).alias("step"), "pos", "href", F.lit("html").alias("source_type")))
    parts.append(fixed(pages, 1001, "/sitemap.xml", "sitemap"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("source_type is not null").withColumn("endpoint", U.resolve_url(F.col("href"), F.col("url"))).where("endpoint is not null")
    every = every.where(_same_site(F.col("endpoint"), F.col("url")))
    first = every.groupBy("url", "endpoint").agg(F.min(F.struct("step", "pos", "source_type")).alias("f"))
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in prefer]), F.col("f.source_type")), F.lit(99))
    order = F.when(order == 0, 99).otherwise(order)
    rank = F.row_number().over(Window.partitionBy("url").orderBy(order, "f.step", "f.pos", "endpoint"))
    return first.select("url", rank.alias("rank"), "endpoint", F.col("f.source_type").alias("source_type"))


def _unwrapped(c: Column) -> Column:
    """A text out of its CDATA sections."""
    return T.within_last(c, r"\]\]>", lambda head: F.regexp_replace(head, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def sitemap_locations(body: Column) -> Column:
    """The addresses of a sitemap."""
    found = F.regexp_extract_all(T.up_to_last(body, "</loc>"), F.lit(r"(?is)<loc\b[^<>]*>(.*?)</loc>"), F.lit(1))
    return F.transform(found, lambda x: F.btrim(x, F.lit(" \t\n\r\f\v")))


def feed_articles(feeds: DataFrame) -> DataFrame:
    """(url, pos, link, title) of each feed's articles on its own site. ``feeds``: url, source_type, text; RSS and Atom items,
    sitemap locations, JSON lists (bare or under ``items``) and, of pages, anchors."""
    kind, none = F.col("source_type"), F.array().cast("array<struct<link:string,title:string>>")
    body = F.col("text")
    json_like = kind.isin("json", "api") | (body.rlike(r"^\s*\[") & (kind != "sitemap"))
    xml_like = (kind == "rss") | F.col("url").rlike("(?i)xml|rss|atom")
    text_of = lambda x, tag: strip_tags(_unwrapped(F.regexp_extract(T.up_to_last(x, f"</{tag}>"), rf"(?is)<{tag}\b[^<>]*>(.*?)</{tag}>", 1)))
    href_of = lambda x: F.regexp_extract(x, r"""(?is)<link\b[^<>]*\bhref=["']([^"'<>]+)["']""", 1)
    pair = lambda link, title: F.struct(link.alias("link"), title.alias("title"))
    items = F.transform(F.regexp_extract_all(T.up_to_last(body, "</(?:item|entry)>"), F.lit(ITEM), F.lit(0)), lambda x: pair(F.coalesce(F.nullif(href_of(x), F.lit("")), text_of(x, "link")), text_of(x, "title")))
    locs = F.transform(sitemap_locations(body), lambda x: pair(decode_entities(x), decode_entities(x)))
    schema = "array<struct<url:string,link:string,title:string>>"
    listed = F.coalesce(F.from_json(F.when(body.rlike(r"^\s*\["), body), schema), F.from_json(F.get_json_object(F.when(body.rlike(r"^\s*\{"), body), "$.items"), schema))
    rendered = lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.rendered")).otherwise(t)
    from_json = F.transform(listed, lambda x: pair(F.coalesce(x["url"], x["link"]), rendered(F.coalesce(x["title"], F.lit("")))))
    linked = F.transform(anchors(body), lambda x: pair(decode_entities(F.regexp_extract(x, ANCHOR, 1)), strip_tags(F.regexp_extract(x, ANCHOR, 2))))
    found = F.when(kind == "sitemap", locs).when(json_like, F.coalesce(from_json, none)).when(xml_like, items).otherwise(linked)
    rows = feeds.select("url", F.posexplode(found).alias("pos", "a")).select("url", "pos", U.resolve_url(F.col("a.link"), F.col("url")).alias("link"), F.col("a.title").alias("title"))
    title = T.collapse_ws(F.coalesce("title", F.lit("")))
    return rows.where(F.col("link").isNotNull() & _same_site(F.col("link"), F.col("url"))).withColumn("title", F.when(title != "", title).otherwise(F.col("link")))


def news_links(html: Column, most: int = 20) -> Column:
    """The anchors of a page whose address or text is about news, once each, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(anchors(html), lambda a: a.rlike("(?i)news|event|announcement|press"))), 1, most)


_HEADED = r"(?is)^(?>.*?<h3[^<>]*>)(?>.*?<a\b[^<>]*>)(.*?)</a>"
#: How the hits of a result page are marked, for each layout: what a hit begins with, its title, address and text, and the
#: words of an official badge. Fixed patterns.
SERP = {
    "blocks": (r'(?i)<div class="vrwrap"', _HEADED, r"""(?i)\blinkurl=["']?(https?:[^\s<>"']+)""", r"(?is)<div[^<>]+(?:cacheresult_summary|space-txt)[^<>]*>(.*?)</div>", "官方网站认证|官网认证"),
    "list": (r'(?i)<li class="res-list"', _HEADED, r"""(?i)\bdata-mdurl=["']([^"']+)["']""", r'(?is)<p class="res-desc"[^<>]*>(.*?)</p>', "官网|官方网站"),
    "anchors": (r"""(?i)<a(?=[^<>]+class=["'][^"']*result__a)""", r"(?is)^[^>]*>(.*?)</a>", r"""(?i)^[^>]*\bhref=["']([^"']+)["']""", r"(?!x)x", r"(?!x)x"),
}


def parse_serp(pages: DataFrame, key: str, layout: str, most: int = 8) -> DataFrame:
    """(key, pos, url, title, snippet, badge) of result pages: the first ``most`` hits, each URL once; an address that leads over
    the search engine is resolved."""
    begin, title, address, text, badge = SERP[layout]
    split = F.split("html", begin)
    hits = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0))) if layout == "anchors" else F.slice(split, 2, most)
    rows = pages.select(key, F.posexplode(hits).alias("pos", "_h"))
    closed = T.up_to_last(F.col("_h"), "</(?:a|div|p)>")
    raw = decode_entities(F.regexp_extract("_h", address, 1))
    target = F.regexp_extract(raw, r"[?&]uddg=([^&]+)", 1)
    url = U.canonical_url(F.when(target != "", F.try_url_decode(target)).otherwise(raw), force_https=True)
    made = rows.select(key, "pos", url.alias("url"), strip_tags(F.regexp_extract(closed, title, 1)).alias("title"), strip_tags(F.regexp_extract(closed, text, 1)).alias("snippet"), F.substring("_h", 1, 5000).rlike(badge).alias("badge"))
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("pos"))
    once = made.where("url is not null and title <> ''").withColumn("_f", first).where("_f = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= most).drop("_f", "_n")


#: Words of an article's address or title, and of a page of news. Fixed values.
ARTICLE_HINT = "(?i)news|blog|press|story|stories|update|insight|announce|award|funding|launch|partner|新闻|动态|资讯|发布|融资|合作|活动"
NEWS_HINT = "(?i)news|newsroom|blog|press|media|updates?|insights?|stories|journal|announcements?|新闻|新闻中心|动态|资讯|媒体|公告|要闻|聚焦|最新"


def article_link_count(pages: DataFrame, most: int = 20) -> DataFrame:
    """(url, n): links of a page that look like articles: https, the same site, a text of 7 to 260 characters, two path parts
    or more, a word of news in path or text; at most ``most`` are counted."""
    links = page_links(pages.select("url", "html"))
    path = F.regexp_extract("link", U.URL, 5)
    deep = F.size(F.filter(F.split(path, "/"), lambda x: x != "")) >= 2
    good = F.col("link").startswith("https://") & F.length("text").between(7, 260) & deep & _same_site(F.col("link"), F.col("url")) & F.concat_ws(" ", path, "text").rlike(ARTICLE_HINT)
    counts = links.where(good).groupBy("url").agg(F.least(F.countDistinct("link"), F.lit(most)).alias("n"))
    return pages.select("url").distinct().join(counts, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))


def locate_news_page(endpoints: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, news_page) of each site: its first endpoint, by rank, that has articles; else the homepage if it has two. ``counts``
    (url, n; ``title`` if it is known) has the articles of each fetched document by its own kind: article links of pages
    (``article_link_count``), items of feeds, sitemaps and lists (``feed_article_count``). A page needs two article links, or
    one where its address or title speaks of news; any other endpoint needs one item."""
    title = F.col("title") if "title" in counts.columns else F.lit("")
    seen = endpoints.join(counts.select(F.col("url").alias("endpoint"), "n", title.alias("_title")), "endpoint")
    told = F.concat_ws(" ", "endpoint", "_title").rlike(NEWS_HINT)
    enough = F.when(F.col("source_type") == "html", (F.col("n") >= 2) | (told & (F.col("n") >= 1))).otherwise(F.col("n") >= 1)
    best = seen.where(enough).groupBy("url").agg(F.min_by("endpoint", "rank").alias("_found"))
    home = counts.where("n >= 2").select("url", F.col("url").alias("_home"))
    sites = endpoints.select("url").distinct().join(best, "url", "left").join(home, "url", "left")
    return sites.select("url", F.coalesce("_found", "_home").alias("news_page"))


def meta_tags(html: Column) -> Column:
    """The meta tags of a page, in order."""
    return F.regexp_extract_all(T.up_to_last(html, ">"), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))


def meta_name(tag: Column) -> Column:
    return F.regexp_extract(tag, r"""(?is)\b(?:name|property)\s*=\s*["']([^"']+)["']""", 1)


#: The fields of a page's description by others. Fixed values.
OG_FIELDS = ["og:title", "og:description", "og:type", "og:url", "og:image", "og:site_name"]


def page_meta(pages: DataFrame) -> DataFrame:
    """(url, title, description, descriptions, og) of each page: the title of its head; the first description that is not blank,
    or its og form; all of both kinds, joined by spaces in order; a map of the og fields that are not blank, the first of each."""
    pair = lambda m: F.struct(F.lower(meta_name(m)).alias("key"), strip_tags(attribute(m, "content")).alias("value"))
    read = pages.select("url", T.page_title(F.col("html")).alias("title"), F.transform(meta_tags(F.col("html")), pair).alias("_m"))
    some = lambda *keys: F.transform(F.filter("_m", lambda x: x["key"].isin(*keys) & (x["value"] != "")), lambda x: x["value"])
    both = F.coalesce(F.try_element_at(some("description"), F.lit(1)), F.try_element_at(some("og:description"), F.lit(1)))
    fields = [F.struct(F.lit(k).alias("key"), F.try_element_at(some(k), F.lit(1)).alias("value")) for k in OG_FIELDS]
    og = F.map_from_entries(F.filter(F.array(*fields), lambda x: x["value"].isNotNull()))
    return read.select("url", "title", both.alias("description"), F.array_join(some("description", "og:description"), " ").alias("descriptions"), og.alias("og"))


def article_details(pages: DataFrame) -> DataFrame:
    """(url, title, summary, published): the summary is the description of the page, else its first paragraph of 80 to 1,200
    characters that is not about cookies or privacy."""
    html = F.col("html")
    meta = lambda names: F.try_element_at(F.filter(F.transform(F.filter(meta_tags(html), lambda m: meta_name(m).isin(names)), lambda m: decode_entities(attribute(m, "content"))), lambda x: x != ""), F.lit(1))
    paragraphs = F.transform(F.regexp_extract_all(T.up_to_last(html, "</p>"), F.lit(r"(?is)<p\b[^<>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    first = F.try_element_at(F.filter(paragraphs, lambda p: F.length(p).between(80, 1200) & ~p.rlike("(?i)cookie|privacy|隐私")), F.lit(1))
    title = F.coalesce(meta(["og:title"]), F.nullif(strip_tags(F.regexp_extract(T.up_to_last(html, "</h1>"), r"(?is)<h1\b[^<>]*>(.*?)</h1>", 1)), F.lit("")), F.nullif(T.page_title(html), F.lit("")))
    return pages.select("url", title.alias("title"), F.coalesce(meta(["description", "og:description"]), first).alias("summary"), meta(["article:published_time", "datePublished"]).alias("published"))


def extract_articles(pages: DataFrame, least: int = 120, key: str | None = None) -> DataFrame:
    """(url, title, publish_time, author, author_url, contents, platform, method, confidence, warnings): structured articles.
    Title, time and author come from JSON-LD, then meta fields, then tags. The body is what the rule of the page's platform
    finds (confidence 0.95), else what one of the general rules finds, whichever scores highest by its text, paragraphs and
    links (0.65); its items are paragraphs, ``##`` headings, ``•`` list items, images and videos, once each. Pages without a
    title or with less than ``least`` characters of body give no row. ``key``: a column of whole numbers to keep, last."""
    columns = [c.split()[0] for c in A.ARTICLE.split(", ")] + ([key] if key else [])

    def read(batches):
        for batch in batches:
            told = map(A.read_article, batch["url"], batch["html"], [least] * len(batch))
            found = [x | {key: k} if key else x for x, k in zip(told, batch[key or "url"]) if x]
            yield pd.DataFrame(found, columns=columns)

    return pages.select("url", "html", *([key] if key else [])).mapInPandas(read, A.ARTICLE + (f", {key} long" if key else ""))


def first_articles(pages: DataFrame, pos: str, least: int = 120) -> DataFrame:
    """The article of each URL's first page by ``pos``; none where that page has none, whatever later pages of the URL have."""
    first = pages.groupBy("url").agg(F.min(pos).alias(pos))
    return extract_articles(pages, least, pos).join(first, ["url", pos], "left_semi")


def with_snippet_fallback(articles: DataFrame, snippets: DataFrame) -> DataFrame:
    """Every snippet (url, title, summary) with its article's contents, or with its own summary at confidence 0.2."""
    summary = T.collapse_ws(F.col("summary"))
    own = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.array(F.struct(F.lit("text").alias("type"), summary.alias("content"), summary.alias("desc"))))
    joined = snippets.join(articles.select("url", F.col("title").alias("_t"), "contents", "confidence", "method", "warnings"), "url", "left")
    method, warnings = F.coalesce("method", F.lit("snippet-fallback")), F.coalesce("warnings", F.array(F.lit("structured article content was not found")))
    made = joined.select("url", F.coalesce("_t", "title").alias("title"), F.coalesce("contents", own).alias("contents"), F.coalesce("confidence", F.lit(0.2)).alias("confidence"), method.alias("method"), warnings.alias("warnings"))
    return made.where("title is not null or contents is not null")


def is_plausible_name(c: Column) -> Column:
    """A text that has the form of an organization's name as a whole."""
    english = rf"[A-Z][A-Za-z0-9&'.-]*(\s+[A-Z][A-Za-z0-9&'.-]*){{0,8}}\s+({'|'.join(ENGLISH_SUFFIXES)})"
    chinese = rf"[\x{{4E00}}-\x{{9FFF}}A-Za-z0-9& .-]{{2,60}}({'|'.join(CHINESE_SUFFIXES)})"
    generic = r"^([0-9]|一个|一些|多个|许多|各类|不同|相关|主要|部分|所有|该|本|这|其)"
    return F.length(c).between(2, 100) & c.rlike(f"^({english}|{chinese})$") & ~c.rlike(generic) & ~c.isin(CHINESE_SUFFIXES)


#: What follows a name in prose: a part with such a word is a sentence, not a name. Fixed values.
FRAGMENT = (
    "成立|设立|负责|推动|支持|依托|位于|拥有|包括|提供|开展|通过|成为|作为|建立|联合|合作|运营|实施|下设|正式|源自|需要|可以|能够|应该|如何|已经|正在|形成|围绕|量身"
    "|(是|由|等|则|将|会|已|需|应|被|从|向)."
)


def is_sentence_fragment(c: Column) -> Column:
    return c.rlike(FRAGMENT)


#: What the header of a column of names contains. Fixed values.
NAME_HEADER = "机构|单位|企业|公司|学校|高校|大学|院校|科研机构|实验室|医院|协会|学会|联盟|平台"
ENGLISH_NAME = rf"\b([A-Z][A-Za-z0-9&'.-]*(?:\s+[A-Z][A-Za-z0-9&'.-]*){{0,8}}\s+(?:{'|'.join(ENGLISH_SUFFIXES)}))\b"


def names_from_tables(cells: DataFrame) -> DataFrame:
    """(table_id, row_no, col_no, name) out of the cells (table_id, row_no, col_no, text) of tables: of each column whose header,
    in row 0, is about organizations, the values between separators that are names as a whole, else the English names in them.
    Repeats within a cell are given once; cells without a text or beyond the header's columns give none."""
    at = ["table_id", "col_no"]
    headed = cells.where((F.col("row_no") == 0) & F.col("text").rlike(NAME_HEADER)).select(*at).distinct()
    body = cells.where("row_no > 0 and text is not null").select(*at, "row_no", "text").join(headed, at, "left_semi")
    parts = body.select(*at, "row_no", F.explode(F.split("text", SEPARATORS)).alias("part")).withColumn("part", T.clean_name(F.col("part")))
    whole = is_plausible_name(F.col("part")) & ~is_sentence_fragment(F.col("part"))
    names = F.when(whole, F.array("part")).otherwise(F.regexp_extract_all("part", F.lit(ENGLISH_NAME), F.lit(1)))
    found = parts.select("table_id", "row_no", "col_no", F.explode(names).alias("name")).where(is_plausible_name(F.col("name")))
    return found.distinct()


def extract_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name): names of organizations in texts: whole parts between separators, and English names inside prose."""
    parts = docs.select(key, F.posexplode(F.split(text, SEPARATORS)).alias("pos", "part")).withColumn("part", T.clean_name(F.col("part")))
    whole = F.when(is_sentence_fragment(F.col("part")), F.array().cast("array<string>")).otherwise(F.array("part"))
    names = F.concat(whole, F.regexp_extract_all("part", F.lit(ENGLISH_NAME), F.lit(1)))
    return parts.select(key, "pos", F.explode(F.array_distinct(names)).alias("name")).where(is_plausible_name(F.col("name")))
