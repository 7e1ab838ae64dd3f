"""Filters and the tests behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

#: Words and patterns that the tests look for.
GARBAGE_WORDS = ["登录", "注册", "广告", "cookie", "404", "undefined", "null", "首页", "加载中"]
SNIPPET_GARBAGE = ["登录", "注冊", "注册", "广告", "cookie", "404", "隐私政策", "加载中", "首页"]
NAME_MARKERS = ["的", "了", "进一步", "起源于", "跻身", "落实", "战略布局", "平台", "总部", "研发中心"]
ENTITY_WORDS = [
    "University", "Institute", "Organization", "Foundation", "Association", "Center", "Centre", "Lab", "Laboratory", "College", "Academy",
    "Authority", "Department", "Museum", "Hospital", "School", "Council", "Society", "Federation", "Agency", "Corporation", "Company",
]
BAD_SEGMENTS = ["blog", "article", "post", "video", "login", "register", "shop", "forum"]
SUMMARY_KEYWORDS = [
    ("copyright", "(?i)版权所有|copyright"), ("icp", r"(?i)ICP备案|icp\s*(备案|beian)"), ("login", "登录|注册"), ("navigation", "首页|联系我们|广告"), ("cookie", "(?i)cookie|隐私政策"),
]
PARKED = r"(?i)domain (is )?for sale|buy this domain|parked (free|domain)|sedo domain parking|afternic|hugedomains|dan\.com/buy-domain|该域名出售|域名正在出售"
ORG_SEARCH = ("name", "description", "summary", "context")


def search_orgs(df: DataFrame, text: str, columns: tuple[str, ...] = ORG_SEARCH) -> DataFrame:
    """Rows that hold ``text`` literally, whatever its case, in one of the columns; all rows for a blank text."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in columns:
        if c in df.columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False))
    return df.where(hit)


def search_events(df: DataFrame, text: str, columns: tuple[str, ...], literal: bool = False) -> DataFrame:
    """As ``search_orgs`` over the columns, but ``%`` and ``_`` are wildcards unless ``literal``."""
    if literal:
        return search_orgs(df, text, columns)
    if not text.strip():
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text.strip()}%"), F.lit(False))
    return df.where(hit)


def institution_query(c: Column) -> Column:
    """The institution that a question names, by the ending of its name; else the question without its marks."""
    bare = F.substring(F.trim(F.regexp_replace(c, "[？?。！!，,；;：:]", " ")), 1, 200)
    named = F.regexp_extract(bare, r"[\x{4E00}-\x{9FFF}A-Za-z0-9·&（）()-]{2,80}(大学|学院|研究院|研究所|实验室|基金会|公司|协会)", 0)
    return F.trim(F.when(named != "", named).otherwise(bare))


def filter_core(df: DataFrame, core: bool | None) -> DataFrame:
    return df if core is None else df.where(F.coalesce(F.col("is_core_tracking"), F.lit(False)) == core)


def filter_category(df: DataFrame, wanted: str, column: str = "event_type") -> DataFrame:
    """Events of a category; another word is looked for in the type itself."""
    if not wanted.strip():
        return df
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    words = T.CATEGORIES.get(wanted.strip().lower())
    return df.where(low.rlike("|".join(words)) if words else low.contains(wanted.strip().lower()))


def recent_scored(df: DataFrame, start: str, end: str, min_score: int) -> DataFrame:
    """Rows created from ``start`` on, before ``end``, with at least the score."""
    c = F.col("created_at")
    return df.where((c >= start) & (c < end) & (F.col("relevance_score") >= min_score))


def is_garbage_event(title: Column, summary: Column) -> Column:
    both = F.lower(F.concat_ws("\n", title, summary))
    return both.rlike("|".join(GARBAGE_WORDS))


def snippet_quality(text: Column) -> Column:
    """too_short, garbage, both or ok."""
    short, bad = F.length(F.trim(text)) < 20, F.lower(text).rlike("|".join(SNIPPET_GARBAGE))
    return F.when(short & bad, "both").when(short, "too_short").when(bad, "garbage").otherwise("ok")


def due_for_search(df: DataFrame, now: str, skip_hours: int = 24, resume: bool = False, force: bool = False) -> DataFrame:
    """Organizations to search again: pending, searched too long ago or never, and failed ones when resuming."""
    if force:
        return df
    last = F.col("last_event_searched_at")
    stale = last.isNull() | (last < F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(skip_hours)))
    status = F.col("event_search_status")
    return df.where(((status == "failed") | (status == "pending")) if resume else ((status == "pending") | stale))


def needs_enrichment(df: DataFrame, force: bool = False, least: int = 80) -> DataFrame:
    return df if force else df.where(F.length(F.trim(F.coalesce("description", F.lit("")))) < least)


def needs_translation(df: DataFrame, column: str, key: str, done: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Rows whose text is less than half Han, without those already done, but with those that failed."""
    wanted = df.where((F.trim(F.coalesce(column, F.lit(""))) != "") & (T.han_ratio(F.col(column)) < 0.5))
    if done is not None:
        finished = done.select(key) if failed is None else done.select(key).join(failed.select(key), key, "left_anti")
        wanted = wanted.join(finished, key, "left_anti")
    return wanted


def is_low_quality_url(url: Column, domains: list[str] | None = None) -> Column:
    """Hosts of platforms, or with a label that says blog or forum; also what is no URL."""
    h = U.host(url)
    labels = F.array(*[F.lit(x) for x in ("blog", "blogs", "forum", "forums", "bbs")])
    return F.coalesce(U.is_under(h, domains or U.LOW_QUALITY_DOMAINS) | F.arrays_overlap(F.split(h, r"\."), labels), F.lit(True))


def is_rejected_url(url: Column) -> Column:
    """Candidates that cannot be a homepage: platforms, document files, what is no URL."""
    h, path = U.host(url), F.lower(F.regexp_extract(url, U.URL, 5))
    return F.coalesce(U.is_platform_host(h) | path.rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv|jpg|png)$"), F.lit(True))


def is_invalid_name(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | c.rlike(r"<.*>") | F.lower(c).rlike(r"</?(div|a|span)")


def empty_shells(orgs: DataFrame, events: DataFrame, least: int = 10) -> DataFrame:
    """Organizations without a website, without a description of some length and without events."""
    bare = (F.trim(F.coalesce("website_url", F.lit(""))) == "") & (F.length(F.trim(F.coalesce("description", F.lit("")))) < least)
    return orgs.where(bare).join(events.select(F.col("organization_id").alias("entity_id")), "entity_id", "left_anti")


def is_suspicious_name(c: Column) -> Column:
    return (F.length(c) > 20) | c.rlike("|".join(NAME_MARKERS))


def is_definitely_valid(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z\s'-]{2,39}$") | c.rlike(r"(?i)\b(" + "|".join(ENTITY_WORDS) + r")\b")


def website_rules(url: Column) -> Column:
    """Labels of the rules that a website breaks; empty for none or no website."""
    full = U.with_scheme(F.trim(url))
    h = U.host(full)
    segments = F.filter(F.transform(F.split(F.regexp_extract(full, U.URL, 5), "/"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    first = F.try_element_at(segments, F.lit(1))
    bad = F.array(*[F.lit(x) for x in BAD_SEGMENTS])
    rules = F.array(
        F.when(U.is_under(h, U.UGC_DOMAINS), "platform"),
        F.when(F.arrays_overlap(segments, bad), "path"),
        F.when((first == "news") & (F.size(segments) > 1), "news_path"),
        F.when(F.size(segments) > 5, "deep_path"),
    )
    none = F.array().cast("array<string>")
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", none).when(h.isNull(), F.array(F.lit("invalid_url"))).otherwise(F.array_compact(rules))


def summary_rules(c: Column) -> Column:
    """Labels of the rules that a description breaks. On a long text (over 2,000 characters) only login words count among
    the keywords."""
    t = F.trim(F.coalesce(c, F.lit("")))
    long = F.length(t) > 2000
    rules = [F.when(t.rlike(p) & (~long if name != "login" else F.lit(True)), name) for name, p in SUMMARY_KEYWORDS]
    rules += [F.when(F.length(t) < 20, "short"), F.when(T.stopword_ratio(t) >= 0.45, "stopwords")]
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*rules)))


def is_spam_page(h: Column, text: Column) -> Column:
    return h.rlike(r"(^|\.)(blog|forum|bbs|medium|wordpress|zhihu|reddit|quora)\.") | text.rlike("(?i)powered by wordpress|论坛|博客|讨论区|sign in to continue")


def is_parked_page(text: Column) -> Column:
    return text.rlike(PARKED)


def content_type_ok(source_type: Column, content_type: Column) -> Column:
    t = F.lower(content_type)
    return (
        F.when(source_type == "html", t.rlike("html"))
        .when(source_type.isin("rss", "atom", "sitemap"), t.rlike("xml|rss|atom"))
        .when(source_type.isin("json", "api"), t.rlike("json"))
        .otherwise(F.lit(False))
    )
