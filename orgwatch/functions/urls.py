"""URL functions on one pattern of our own, which keeps hosts with ``_`` and paths with spaces or letters of any script.

The pattern has no look-around, so that the same text works in other engines. Not covered: punycode, percent-encoding
of characters that a browser would encode. A text that does not match gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: 1 scheme, 2 user, 3 host, 4 port, 5 path, 6 query, 7 fragment.
URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\s]+)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

#: Hosts that are never an organization's own.
PLATFORM_ROOTS = [
    "baidu.com", "bilibili.com", "douban.com", "facebook.com", "google.com", "instagram.com", "linkedin.com", "play.google.com", "quora.com",
    "reddit.com", "twitter.com", "wikipedia.org", "wikimedia.org", "weibo.com", "x.com", "youtube.com", "zhihu.com",
]
UGC_DOMAINS = ["blogspot.com", "wordpress.com", "medium.com", "youtube.com", "tiktok.com", "facebook.com", "twitter.com", "linkedin.com", "weibo.com"]
LOW_QUALITY_DOMAINS = [
    "zhihu.com", "twitter.com", "x.com", "facebook.com", "weibo.com", "reddit.com", "quora.com", "medium.com", "wordpress.com", "blogspot.com", "tiktok.com", "instagram.com",
]
BLOCKED_DOMAINS = [
    "wikipedia.org", "baidu.com", "zhihu.com", "facebook.com", "twitter.com", "x.com", "threads.com", "threads.net", "linkedin.com", "youtube.com",
    "qq.com", "sina.com.cn", "sohu.com", "163.com", "ifeng.com", "thepaper.cn", "toutiao.com", "weibo.com", "douyin.com",
]
PREFERRED_DOMAINS = ["wikipedia.org", "linkedin.com", "crunchbase.com"]
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz"]
SECOND_LEVEL = ["com", "org", "net", "edu", "gov", "ac", "co"]
LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, URL, group)


def with_scheme(c: Column) -> Column:
    """``https://`` before a text that names no scheme."""
    return F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))


def canonical_url(c: Column, drop_slash: bool = False, force_https: bool = False) -> Column:
    """http(s) URL with scheme and host in lower case, no default port, at least ``/`` as path and no fragment; else null."""
    scheme, port = F.lower(_part(c, 1)), _part(c, 4)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    user, path = _part(c, 2), F.rtrim(_part(c, 5))
    path = F.when(path == "", "/").otherwise(path)
    if drop_slash:
        path = F.regexp_replace(path, "/+$", "")
    whole = F.concat(
        F.when(F.lit(force_https), F.lit("https")).otherwise(scheme), F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), F.lower(_part(c, 3)),
        F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.rtrim(_part(c, 6)),
    )
    return F.when(scheme.isin("http", "https"), whole)


def host(c: Column) -> Column:
    """Host in lower case without ``www.``; null for a text that is no URL."""
    h = F.regexp_replace(F.lower(_part(c, 3)), r"^www\.", "")
    return F.when(h != "", h)


def site_key(c: Column) -> Column:
    """The registrable domain: the last two labels, or three below a two-part suffix."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^https?://", ""), "[/?#].*$", "")
    labels = F.filter(F.split(F.regexp_replace(h, r"^www\.", ""), r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, F.regexp_replace(h, r"^www\.", "")).when((F.size(labels) >= 3) & last(2).isin(TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def domain_suffix(c: Column) -> Column:
    """``.`` and the last two labels of the host, three where the second last is a common second level."""

    def suffix(h: Column) -> Column:
        labels = F.split(h, r"\.")
        last = lambda n: F.concat(F.lit("."), F.array_join(F.slice(labels, -n, n), "."))
        second = F.try_element_at(labels, F.lit(-2))
        return F.when(F.size(labels) < 2, F.concat(F.lit("."), h)).when(second.isin(SECOND_LEVEL) & (F.size(labels) >= 3), last(3)).otherwise(last(2))

    return F.transform(F.array(host(with_scheme(c))), suffix)[0]  # a lambda over one item: the host is found once


def is_under(h: Column, roots: list[str]) -> Column:
    """Whether a host is one of ``roots`` or lies below one: one pattern for all of them."""
    return h.rlike(r"(^|\.)(" + "|".join(r.replace(".", r"\.") for r in roots) + ")$")


def is_platform_host(h: Column) -> Column:
    return is_under(h, PLATFORM_ROOTS)


def is_blocked_host(h: Column) -> Column:
    """Whether a host belongs to an aggregator."""
    return is_under(h, BLOCKED_DOMAINS)


def official_domain(c: Column) -> Column:
    """A text or URL's host if it can be an organization's own domain, else null."""
    full = with_scheme(F.trim(c))
    h = host(full)
    good = F.lower(_part(full, 1)).isin("http", "https") & h.rlike(rf"^({LABEL}\.)+[a-z]{{2,63}}$") & (F.length(h) <= 253) & ~is_platform_host(h)
    return F.when((F.trim(c) != "") & good, h)


def is_official(source_url: Column, website: Column) -> Column:
    """Whether a source lies on the website's host, above or below it."""
    s, w = host(with_scheme(source_url)), host(with_scheme(website))
    dot = F.lit(".")
    return F.coalesce((s == w) | F.endswith(s, F.concat(dot, w)) | F.endswith(w, F.concat(dot, s)), F.lit(False))


def article_id(c: Column) -> Column:
    """The last part of the path, decoded; the host where the path has none."""
    parts = F.filter(F.split(_part(c, 5), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.try_url_decode(F.try_element_at(parts, F.lit(-1)))).otherwise(host(c))


def url_safety(c: Column) -> Column:
    """invalid_url, unsupported_protocol, credentials_not_allowed, private_address or ok."""
    scheme, user, h = F.lower(_part(c, 1)), _part(c, 2), F.lower(_part(c, 3))
    private = h.rlike(
        r"^(localhost|.*\.localhost|.*\.local|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*"
        r"|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\..*|\[::1?\]|\[f[cd].*\]|\[fe[89ab].*\]|\[::ffff:.*\])$"
    )
    return (
        F.when(scheme == "", F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "unsupported_protocol").otherwise("invalid_url"))
        .when(~scheme.isin("http", "https"), "unsupported_protocol")
        .when((user != ""), "credentials_not_allowed")
        .when(private, "private_address")
        .otherwise("ok")
    )


def _clean_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(kept, x):
        back = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(x == "..", back).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    ends = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(F.aggregate(parts, none, step), "/"), ends)


def resolve_url(href: Column, base: Column) -> Column:
    """An absolute http(s) URL without fragment from a link and the URL of its page; null for other schemes."""
    h = F.trim(href)
    site = F.concat(F.lower(_part(base, 1)), F.lit("://"), F.lower(_part(base, 3)), F.when(_part(base, 4) != "", F.concat(F.lit(":"), _part(base, 4))).otherwise(""))
    path = F.when(_part(base, 5) == "", "/").otherwise(_part(base, 5))
    bare = F.regexp_replace(h, "#.*$", "")
    query, steps = F.regexp_extract(bare, r"(\?.*)$", 1), F.regexp_replace(bare, r"\?.*$", "")
    rooted = F.when(steps.startswith("/"), steps).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), steps))
    return (
        F.when(h.rlike("(?i)^https?://"), canonical_url(h))
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(h.startswith("//"), canonical_url(F.concat(F.lower(_part(base, 1)), F.lit(":"), h)))
        .when(bare == "", F.concat(site, path, _part(base, 6)))
        .when(bare.startswith("?"), F.concat(site, path, query))
        .otherwise(F.concat(site, _clean_path(rooted), query))
    )
