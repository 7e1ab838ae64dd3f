"""Registered queries: each applies one operator to whole tables, with DuckDB SQL of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo as V
from .functions import dates as D
from .functions import markup
from .functions import normalize as N
from .functions import text as T
from .functions import urls as U
from .operators import dedup, extract, joins, match, model_io, stats, topk, views, writes
from .operators import predicates as P
from .plans import audit, cleaning
from .streaming import health

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = V.with_views(sql)


# Column functions: over the URLs of pages, the texts of documents and other columns. ------------------------------


def _over(view: Callable[[SparkSession, str], DataFrame], key: str, column: Callable[[], Column]) -> Query:
    return lambda spark, d: view(spark, d).select(key, column().alias("value"))


def _function(name: str, column: Callable[[], Column], sql: str, view=V.pages, key: str = "page_id", frm: str = "v_page") -> None:
    _add(name, _over(view, key, column), f"SELECT {key}, {sql} AS value FROM {frm}")


def _with_meta() -> Column:
    """Pages with meta fields of their own, but for each third."""
    told = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url"))
    begin, middle, end = '<meta content="', " &amp; more\" name=\"Description\"><META property='og:description' content='", "'><meta property=\"og:title\" content=\""
    own = F.concat(F.lit(begin), F.substring("host", 1, 9), F.lit(middle), told, F.lit(end), "host", F.lit('"></head>'))
    return F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.replace("html", F.lit("</head>"), own))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents")


_u = lambda: F.col("url")  # noqa: E731  columns need a session, this module must not
_p = [V.sql_part("url", g) for g in range(8)]
_host = V.sql_host("url")
_full = "CASE WHEN regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {c} ELSE 'https://' || {c} END"
_under = lambda h, roots: f"regexp_matches({h}, '(^|\\.)({'|'.join(r.replace('.', chr(92) + '.') for r in roots)})$')"
_canonical = f"""CASE WHEN lower({_p[1]}) IN ('http', 'https') THEN lower({_p[1]}) || '://' || CASE WHEN {_p[2]} <> '' THEN {_p[2]} || '@' ELSE '' END || lower({_p[3]})
    || CASE WHEN {_p[4]} = '' OR (lower({_p[1]}) = 'http' AND {_p[4]} = '80') OR (lower({_p[1]}) = 'https' AND {_p[4]} = '443') THEN '' ELSE ':' || {_p[4]} END
    || CASE WHEN rtrim({_p[5]}) = '' THEN '/' ELSE rtrim({_p[5]}) END || rtrim({_p[6]}) END"""
_function("f15_canonical_url", lambda: U.canonical_url(_u()), _canonical)
_function("f16_host", lambda: U.host(_u()), _host)
_key = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '[/?#].*$', ''), '^www\\.', '')"
_labels = f"list_filter(string_split({_key}, '.'), lambda x: x <> '')"
_two = ", ".join(f"'{x}'" for x in U.TWO_PART_SUFFIXES)
_function(
    "f17_site_key", lambda: U.site_key(_u()),
    f"CASE WHEN len({_labels}) < 2 THEN {_key} WHEN len({_labels}) >= 3 AND array_to_string({_labels}[-2:], '.') IN ({_two}) THEN array_to_string({_labels}[-3:], '.') ELSE array_to_string({_labels}[-2:], '.') END",
)
_hl = "string_split(host, '.')"
_second = ", ".join(f"'{x}'" for x in U.SECOND_LEVEL)
_suffix = f"CASE WHEN len({_hl}) < 2 THEN '.' || host WHEN len({_hl}) >= 3 AND {_hl}[-2] IN ({_second}) THEN '.' || array_to_string({_hl}[-3:], '.') ELSE '.' || array_to_string({_hl}[-2:], '.') END"
_function("f18_domain_suffix", lambda: U.domain_suffix(_u()), _suffix)
_official = f"CASE WHEN regexp_matches(host, '^({U.LABEL}\\.)+[a-z]{{2,63}}$') AND length(host) <= 253 AND NOT {_under('host', U.PLATFORM_ROOTS)} THEN host END"
_function("f19_official_domain", lambda: U.official_domain(_u()), _official)
_parts = f"list_filter(string_split({_p[5]}, '/'), lambda x: x <> '')"
_function("f22_article_id", lambda: U.article_id(_u()), f"CASE WHEN len({_parts}) > 0 THEN url_decode({_parts}[-1]) ELSE host END")
_function("q12_is_platform_host", lambda: U.is_platform_host(U.host(_u())), _under("host", U.PLATFORM_ROOTS))
_function("q13_is_blocked_host", lambda: U.is_blocked_host(U.host(_u())), _under("host", U.BLOCKED_DOMAINS))
_function("q14_is_low_quality_url", lambda: P.is_low_quality_url(_u()), f"coalesce({_under('host', U.LOW_QUALITY_DOMAINS)} OR list_has_any({_hl}, ['blog', 'blogs', 'forum', 'forums', 'bbs']), true)")
_function("q15_is_rejected_url", lambda: P.is_rejected_url(_u()), f"coalesce({_under('host', U.PLATFORM_ROOTS)} OR regexp_matches(lower({_p[5]}), '\\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv|jpg|png)$'), true)")
_function("q16_url_safety", lambda: U.url_safety(_u()), f"CASE WHEN lower({_p[1]}) = '' THEN 'invalid_url' WHEN lower({_p[1]}) NOT IN ('http', 'https') THEN 'unsupported_protocol' WHEN {_p[2]} <> '' THEN 'credentials_not_allowed' WHEN regexp_matches(lower({_p[3]}), '^(localhost|10\\.|127\\.)') THEN 'private_address' ELSE 'ok' END")
_seg = f"list_filter(list_transform(string_split({_p[5]}, '/'), lambda x: lower(trim(x))), lambda x: x <> '')"
_bad = ", ".join(f"'{x}'" for x in P.BAD_SEGMENTS)
_function(
    "q23_website_rules", lambda: F.array_join(P.website_rules(_u()), ","),
    f"""array_to_string(list_filter([CASE WHEN {_under('host', U.UGC_DOMAINS)} THEN 'platform' END, CASE WHEN list_has_any({_seg}, [{_bad}]) THEN 'path' END,
        CASE WHEN {_seg}[1] = 'news' AND len({_seg}) > 1 THEN 'news_path' END, CASE WHEN len({_seg}) > 5 THEN 'deep_path' END], lambda x: x IS NOT NULL), ',')""",
)

_t = lambda: F.col("text")


def _doc_function(name: str, column: Callable[[], Column], sql: str) -> None:
    _function(name, column, sql, _docs, "doc_id", "documents")


_doc_function("f1_collapse_ws", lambda: T.collapse_ws(_t()), "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
_doc_function("f2_strip_controls", lambda: T.strip_controls(_t()), "trim(regexp_replace(text, '[\\x{0000}-\\x{001F}\\x{007F}\\x{00A0}\\x{3000} ]+', ' ', 'g'))")
_doc_function("f5_title_key", lambda: T.title_key(_t()), "regexp_replace(lower(text), '[\\s\\p{P}\\p{S}_]+', '', 'g')")
_doc_function("f6_norm_name", lambda: T.norm_name(_t()), "trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))")
_doc_function("f6_loose_name", lambda: T.loose_name(_t()), "regexp_replace(lower(text), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', '', 'g')")
_doc_function("f9_canonical_name", lambda: T.canonical_name(_t()), "trim(regexp_replace(regexp_replace(regexp_replace(text, '[(（\\[【][^)）\\]】]*[)）\\]】]', ' ', 'g'), '[\\s,-]*(19|20)[0-9][0-9]\\s*$', '', 'g'), '\\s+', ' ', 'g'))")
_han = "len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]'))"
_doc_function("f10_han_ratio", lambda: T.han_ratio(_t()), f"CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) > 0 THEN {_han} / length(regexp_replace(text, '\\s+', '', 'g')) ELSE 0.0 END")
_doc_function("f13_truncate_marked", lambda: T.truncate_marked(_t()), "CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END")
_doc_function("f31_error_class", lambda: T.error_class(_t()), "CASE WHEN regexp_matches(text, '(?i)timeout|timed out|ETIMEDOUT') THEN 'api_timeout' WHEN regexp_matches(text, '(?i)network|ECONN|ENOTFOUND|fetch failed|HTTP 5[0-9][0-9]') THEN 'network_error' WHEN regexp_matches(text, '(?i)empty completion|empty response|no response') THEN 'network_error' ELSE 'llm_parse_failed' END")
_snip = "|".join(P.SNIPPET_GARBAGE)
_short, _garb = "length(trim(text)) < 20", f"regexp_matches(lower(text), '{_snip}')"
_doc_function("q8_snippet_quality", lambda: P.snippet_quality(_t()), f"CASE WHEN {_short} AND {_garb} THEN 'both' WHEN {_short} THEN 'too_short' WHEN {_garb} THEN 'garbage' ELSE 'ok' END")
_doc_function("q18_is_invalid_name", lambda: P.is_invalid_name(_t()), "text IS NULL OR trim(text) = '' OR regexp_matches(text, '<.*>') OR regexp_matches(lower(text), '</?(div|a|span)')")
_doc_function("q20_is_suspicious_name", lambda: P.is_suspicious_name(_t()), f"length(text) > 20 OR regexp_matches(text, '{'|'.join(P.NAME_MARKERS)}')")
_doc_function("q21_is_definitely_valid", lambda: P.is_definitely_valid(_t()), f"regexp_matches(text, '^[A-Za-z][A-Za-z\\s''-]{{2,39}}$') OR regexp_matches(text, '(?i)\\b({'|'.join(P.ENTITY_WORDS)})\\b')")
_doc_function("q26_is_parked_page", lambda: P.is_parked_page(_t()), f"regexp_matches(text, '{P.PARKED}')")
_function("x1_visible_text", lambda: T.visible_text(F.col("html")), "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))")
_bare = "regexp_replace(regexp_replace(html, '(?is)^.*?<body[^<>]*>', ''), '(?s)<!--.*?-->', '', 'g')"
_less = lambda tags, c: c if not tags else f"regexp_replace({_less(tags[1:], c)}, '(?is)<{tags[0]}\\b.*?</{tags[0]}>', '', 'g')"
_decoded = lambda c: f"replace(replace(replace(replace(replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_plain = lambda c, to: f"trim(regexp_replace({_decoded(f"regexp_replace({c}, '<[^>]+>', '{to}', 'g')")}, '\\s+', ' ', 'g'))"
_little, _much = _plain(_less(["script", "style", "noscript"], _bare), ""), _plain(_less(sorted(markup.DROPPED), _bare), "")
_function("x1_body_text", lambda: markup.page_text(F.col("html")), f"CASE WHEN length({_much}) >= 200 THEN {_much} ELSE {_little} END")
_content = """regexp_extract(m, '(?is)\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1)"""
_metas = """list_transform(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda m: {'k': lower(regexp_extract(m, '(?is)\\b(?:name|property)\\s*=\\s*["'']([^"'']+)["'']', 1)), 'v': """ + _plain(_content, " ") + "})"
_said = lambda keys: f"list_transform(list_filter(m, lambda x: x.k IN ({keys}) AND x.v <> ''), lambda x: x.v)"
_add(
    "x2_page_meta", lambda s, d: extract.page_meta(V.pages(s, d).withColumn("html", _with_meta())).withColumn("og", F.array_join(F.map_values("og"), "|")),
    f"""WITH p AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN html ELSE replace(html, '</head>', '<meta content="' || substr(host, 1, 9) || ' &amp; more" name="Description"><META property=''og:description'' content='''
            || CASE WHEN page_id % 5 = 0 THEN '' ELSE url END || '''><meta property="og:title" content="' || host || '"></head>') END AS html FROM v_page),
        r AS (SELECT url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, {_metas} AS m FROM p)
        SELECT url, title, coalesce({_said("'description'")}[1], {_said("'og:description'")}[1]) AS description, coalesce(array_to_string({_said("'description', 'og:description'")}, ' '), '') AS descriptions,
        coalesce(array_to_string(list_concat({_said("'og:title'")}[:1], {_said("'og:description'")}[:1]), '|'), '') AS og FROM r""",
)
_function("x2_page_title", lambda: T.page_title(F.col("html")), "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))")
_found = [f"TRY_CAST(regexp_extract(summary || ' ' || source_url, '{D.FOUND}', {g}) AS INTEGER)" for g in (1, 2, 3)]
_function(
    "f23_event_date_from", lambda: D.event_date_from(F.col("summary"), F.col("source_url")),
    f"coalesce(strftime(make_date({_found[0]}, 1, 1) + to_months({_found[1]} - 1) + to_days({_found[2]} - 1), '%Y-%m-%d'), 'unknown')", V.events, "id", "v_event",
)
_valid_date = "CASE WHEN regexp_matches(trim(event_date), '^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}($|[T\\s])') AND TRY_CAST(substr(trim(event_date), 1, 10) AS DATE) IS NOT NULL THEN trim(event_date) END"
_function("f24_valid_event_date", lambda: D.valid_event_date(F.col("event_date")), _valid_date, V.events, "id", "v_event")
_category = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(event_type, '')), '{'|'.join(w)}') THEN '{k}'" for k, w in T.CATEGORIES.items()) + " ELSE 'other' END"
_function("f29_category", lambda: T.category(F.col("event_type")), _category, V.events, "id", "v_event")
_garbage = f"regexp_matches(lower(title || chr(10) || summary), '{'|'.join(P.GARBAGE_WORDS)}')"
_function("q7_is_garbage_event", lambda: P.is_garbage_event(F.col("title"), F.col("summary")), _garbage, V.events, "id", "v_event")
_add("f11_stopword_ratio", lambda s, d: _docs(s, d).select("doc_id", F.round(T.stopword_ratio(_t()), 9).alias("value")))
_add("q24_summary_rules", lambda s, d: _docs(s, d).select("doc_id", F.array_join(P.summary_rules(_t()), ",").alias("value")))

# Projections. -----------------------------------------------------------------------------------------------------

_struct = lambda c, fallback: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN trim({c}) ELSE {fallback} END"
_title = _struct("title", "'未命名事件'")
_add(
    "p2_event_view", lambda s, d: views.event_view(V.events(s, d)),
    f"""SELECT id, organization_id, {_title} AS title, {_title} AS translated_title, {_struct('summary', f"coalesce(summary, {_title})")} AS translated_description,
        coalesce({_valid_date}, 'unknown') AS event_date, coalesce(relevance_score, 0) AS relevance_score, event_type, source_url, created_at FROM v_event""",
)
_add(
    "p3_session_view", lambda s, d: views.session_view(V.table(s, d, "conversations")),
    """SELECT conv_id, CASE WHEN t <> '' THEN substr(t, 1, 30) ELSE '新对话' END AS title, n_messages FROM (
        SELECT conv_id, trim(regexp_replace(coalesce(min_by(text, turn) FILTER (role = 'user'), ''), '\\s+', ' ', 'g')) AS t, count(*) AS n_messages FROM conversations GROUP BY conv_id)""",
)
_joined = "SELECT e.*, o.name AS organization_name, o.slug AS organization_slug, o.website_url FROM v_event e JOIN v_org o ON o.entity_id = e.organization_id"
_add(
    "p4_event_list", lambda s, d: views.event_list_view(joins.events_with_org(V.events(s, d), V.orgs(s, d), "inner")),
    f"""SELECT id, organization_id, organization_name, organization_slug, {_title} AS title, {_struct('summary', f"coalesce(summary, {_title})")} AS description,
        {_valid_date} AS event_date, {_category} AS category, source_url FROM ({_joined})""",
)
_add(
    "p5_insight", lambda s, d: views.insight_view(V.events(s, d)),
    f"""SELECT id, organization_id, {_struct('summary', f"CASE WHEN trim(coalesce(summary, '')) <> '' THEN trim(summary) ELSE {_title} END")} AS description,
        {_valid_date} AS event_date, {_category} AS category, source_url FROM v_event""",
)
_add("p6_public_columns", lambda s, d: views.public_columns(V.orgs(s, d), "organizations"), "SELECT entity_id, slug, name, description, website_url FROM v_org")

# Filters. ---------------------------------------------------------------------------------------------------------

_add("q1_search_orgs", lambda s, d: P.search_orgs(V.orgs(s, d), " TH").select("entity_id", "name"), "SELECT entity_id, name FROM v_org WHERE contains(lower(name), 'th') OR contains(lower(description), 'th')")
_add("q1_search_literal", lambda s, d: P.search_orgs(V.orgs(s, d), "%").select("entity_id"), "SELECT entity_id FROM v_org WHERE contains(lower(name), '%') OR contains(lower(description), '%')")
_add("q2_search_events", lambda s, d: P.search_events(V.events(s, d), "th_n%", ("title", "summary")).select("id", "title"), "SELECT id, title FROM v_event WHERE title ILIKE '%th_n%%' OR summary ILIKE '%th_n%%'")
_add("q5_filter_category", lambda s, d: P.filter_category(V.events(s, d), "News").select("id", "event_type"), "SELECT id, event_type FROM v_event WHERE regexp_matches(lower(event_type), 'news|新闻|动态|media')")
_add(
    "q6_recent_scored", lambda s, d: P.recent_scored(_timed(s, d), *_hours(), 6).select("id", "created_at", "relevance_score"),
    "SELECT id, substr(created_at, 12) AS created_at, relevance_score FROM v_event WHERE substr(created_at, 12) >= '06:00:00' AND substr(created_at, 12) < '18:00:00' AND relevance_score >= 6",
)


def _hours() -> tuple[str, str]:
    return "06:00:00", "18:00:00"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time of day as their creation time: all lie within days that differ by scale."""
    return V.events(spark, d).withColumn("created_at", F.substring("created_at", 12, 8))


_add("q10_needs_enrichment", lambda s, d: P.needs_enrichment(V.named(s, d)).select("entity_id", "name"), "SELECT entity_id, name FROM v_named WHERE length(trim(coalesce(description, ''))) < 80")
_add(
    "q19_empty_shells", lambda s, d: P.empty_shells(V.named(s, d), V.named_events(s, d)).select("entity_id", "name"),
    """SELECT entity_id, name FROM v_named WHERE trim(coalesce(website_url, '')) = '' AND length(trim(coalesce(description, ''))) < 10
        AND entity_id NOT IN (SELECT organization_id FROM v_named_event)""",
)

# Joins. -----------------------------------------------------------------------------------------------------------

_add("j1_inner", lambda s, d: joins.events_with_org(V.events(s, d), V.orgs(s, d), "inner").select("id", "organization_name"), f"SELECT id, organization_name FROM ({_joined})")
_add(
    "j2_left", lambda s, d: joins.events_with_org(V.named_events(s, d), V.named(s, d)).select("id", "organization_name", "organization_slug"),
    "SELECT e.id, o.name AS organization_name, o.slug AS organization_slug FROM v_named_event e LEFT JOIN v_named o ON o.entity_id = e.organization_id",
)
_add("j3_orgs_without_events", lambda s, d: joins.orgs_without_events(V.named(s, d), V.named_events(s, d)).select("entity_id"), "SELECT entity_id FROM v_named o WHERE NOT EXISTS (SELECT 1 FROM v_named_event e WHERE e.organization_id = o.entity_id)")
_add("j4_duplicate_name_rows", lambda s, d: joins.duplicate_name_rows(V.named(s, d)).select("entity_id", "name"), "SELECT entity_id, name FROM v_named WHERE name IN (SELECT name FROM v_named GROUP BY name HAVING count(*) > 1)")
_add(
    "j5_event_count", lambda s, d: stats.with_event_count(V.named(s, d), V.named_events(s, d)).select("entity_id", "event_count"),
    "SELECT entity_id, coalesce(n, 0) AS event_count FROM v_named LEFT JOIN (SELECT organization_id, count(*) AS n FROM v_named_event GROUP BY 1) e ON organization_id = entity_id",
)
_add("j6_by_ids", lambda s, d: joins.by_ids(V.named(s, d), V.named_events(s, d).select(F.col("organization_id").alias("entity_id")), "entity_id").select("entity_id"), "SELECT entity_id FROM v_named WHERE entity_id IN (SELECT organization_id FROM v_named_event)")
_add(
    "j7_fresh_events", lambda s, d: joins.fresh_events(V.events(s, d), V.events(s, d).where("id % 3 = 0")).select("id"),
    f"SELECT id FROM v_event WHERE NOT EXISTS (SELECT 1 FROM (SELECT organization_id AS o2, {_canonical.replace('url', 'source_url')} AS u2 FROM v_event WHERE id % 3 = 0) k WHERE o2 = organization_id AND u2 = {_canonical.replace('url', 'source_url')})",
)
_add(
    "j12_name_changes", lambda s, d: joins.name_changes(V.named(s, d), _renamed(s, d)),
    "SELECT entity_id, name AS old_name, upper(name) AS new_name FROM v_named WHERE CAST(substr(entity_id, 5) AS BIGINT) % 7 = 0 AND upper(name) <> name",
)


def _number(c: str = "entity_id") -> Column:
    return F.substring_index(c, "-", -1).cast("long")


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    return V.named(spark, d).withColumn("name", F.when(_number() % 7 == 0, F.upper("name")).otherwise(F.col("name")))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame]]:
    o = V.named(spark, d).withColumn("summary", F.lit(None).cast("string"))
    target = o.where(_number() % 2 == 0)
    first = o.where(_number() % 3 == 0).withColumn("description", F.lit("first"))
    second = o.where(_number() % 3 != 1).withColumn("description", F.lit("second")).withColumn("name", F.upper("name"))
    return target, [first, second]


_add(
    "j13_merge_organizations", lambda s, d: joins.merge_organizations(*_snapshots(s, d)).select("entity_id", "name", "description", "website_url"),
    """SELECT entity_id, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN name ELSE upper(name) END AS name,
        CASE WHEN k % 2 = 0 AND trim(coalesce(description, '')) <> '' THEN description WHEN k % 3 = 0 THEN 'first' WHEN k % 3 = 2 THEN 'second' ELSE description END AS description, website_url
        FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named) t WHERE k % 2 = 0 OR k % 3 <> 1""",
)
_su = _canonical.replace("url", "source_url")
_add(
    "j14_merge_events",
    lambda s, d: joins.merge_events(V.events(s, d).where("id % 4 = 0"), [V.events(s, d).where("id % 4 = 1"), V.events(s, d).where("id % 4 <> 0").withColumn("id", F.col("id") + 1_000_000)], V.orgs(s, d)).select("id", "organization_id", "source_url"),
    f"""WITH t AS (SELECT id, organization_id, source_url, {_su} AS u FROM v_event WHERE id % 4 = 0),
        n AS (SELECT 0 AS r, id, organization_id, source_url, {_su} AS u FROM v_event WHERE id % 4 = 1 UNION ALL SELECT 1, id + 1000000, organization_id, source_url, {_su} FROM v_event WHERE id % 4 <> 0)
        SELECT id, organization_id, source_url FROM t UNION ALL
        SELECT id, organization_id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY r, id) AS k FROM n WHERE u NOT IN (SELECT u FROM t)) WHERE k = 1""",
)

# Statistics. ------------------------------------------------------------------------------------------------------

_add("g1_totals", lambda s, d: stats.totals(V.orgs(s, d), V.events(s, d)), "SELECT (SELECT count(*) FROM v_org ) AS organizations, (SELECT count(*) FROM v_event ) AS events")
_add(
    "g2_domain_stats", lambda s, d: stats.domain_stats(V.orgs(s, d)),
    f"SELECT suffix, count(*) AS n FROM (SELECT {_suffix} AS suffix FROM (SELECT {V.sql_host('website_url')} AS host FROM v_org WHERE website_url IS NOT NULL)) GROUP BY suffix",
)
_add(
    "g3_quality_report", lambda s, d: stats.quality_report(V.named(s, d), V.named_events(s, d)),
    """SELECT 'total' AS metric, count(*) AS value FROM v_named UNION ALL SELECT 'missing_name', count(*) FROM v_named WHERE trim(coalesce(name, '')) = ''
        UNION ALL SELECT 'short_name', count(*) FROM v_named WHERE trim(coalesce(name, '')) <> '' AND length(trim(name)) < 2
        UNION ALL SELECT 'no_site_no_description', count(*) FROM v_named WHERE trim(coalesce(website_url, '')) = '' AND trim(coalesce(description, '')) = ''
        UNION ALL SELECT 'zero_events', count(*) FROM v_named WHERE entity_id NOT IN (SELECT organization_id FROM v_named_event)
        UNION ALL SELECT 'duplicate_names', count(*) FROM (SELECT name FROM v_named GROUP BY name HAVING count(*) > 1)""",
)
_marks = "|".join(P.NAME_MARKERS)
_add(
    "g4_name_report", lambda s, d: stats.name_report(V.named(s, d)),
    f"SELECT count(*) AS total, count(*) FILTER (length(name) > 20) AS long_names, count(*) FILTER (regexp_matches(name, '{_marks}')) AS marked_names, count(*) FILTER (length(name) > 20 OR regexp_matches(name, '{_marks}')) AS suspicious FROM v_named",
)
_add("g5_duplicate_groups", lambda s, d: stats.duplicate_groups(V.named(s, d), "name"), "SELECT name, count(*) AS n FROM v_named GROUP BY name HAVING count(*) > 1")
_class = """CASE WHEN status IN (401, 403) THEN 'manual' WHEN status IN (404, 410) THEN 'reprobe' WHEN status = 429 THEN 'backoff' ELSE 'retry' END"""
_state = "SELECT source_id, max_by(status, (ts, fetch_id)) AS status, max(ts) AS ts, count(*) AS failure_count, count(*) FILTER (status BETWEEN 200 AND 299) AS success_count FROM v_fetch GROUP BY source_id"
_add(
    "g6_source_health_counts", lambda s, d: stats.source_health_counts(health.source_state(V.fetches(s, d))),
    f"SELECT count(*) FILTER (c IN ('retry', 'backoff')) AS retryable, count(*) FILTER (c = 'reprobe') AS reprobe FROM (SELECT {_class} AS c FROM ({_state}))",
)
_add(
    "g7_event_funnel", lambda s, d: stats.event_funnel(V.events(s, d), V.events(s, d).where("relevance_score >= 4"), V.events(s, d).where("relevance_score >= 8")),
    "SELECT organization_id, count(*) AS found, count(*) FILTER (relevance_score >= 4) AS kept, count(*) FILTER (relevance_score >= 8) AS inserted FROM v_event GROUP BY 1",
)
_add(
    "g9_skip_summary", lambda s, d: stats.skip_summary(V.events(s, d).select(T.category(F.col("event_type")).alias("reason"), "id"), "reason", "id").withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")),
    f"""SELECT reason, n, samples FROM (SELECT {_category} AS reason, count(*) AS n FROM v_event GROUP BY 1) JOIN (SELECT reason, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS samples
        FROM (SELECT {_category} AS reason, id, row_number() OVER (PARTITION BY {_category} ORDER BY id) AS k FROM v_event ) WHERE k <= 10 GROUP BY 1) USING (reason)""",
)
_add("g11_page_info", lambda s, d: stats.page_info(V.named(s, d), 2, 50), "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages, 2 < ceil(count(*) / 50) AS has_next, true AS has_previous FROM v_named")

# First rows. ------------------------------------------------------------------------------------------------------

_newest = "CASE WHEN event_date IS NULL OR event_date IN ('', 'unknown') THEN 1 ELSE 0 END, event_date DESC NULLS LAST, created_at DESC NULLS LAST, id"
_recent = f"SELECT * FROM ({_joined}) ORDER BY {_newest} LIMIT 500"
_recently = lambda s, d: topk.recent_events(V.events(s, d), V.orgs(s, d))
_add("t1_recent_events", lambda s, d: _recently(s, d).select("id", "organization_name", "event_date"), f"SELECT id, organization_name, event_date FROM ({_recent})")
_add(
    "t2_top_per_category", lambda s, d: topk.top_per_category(_recently(s, d)).select("category", "rank", "id"),
    f"SELECT * FROM (SELECT {_category} AS category, row_number() OVER (PARTITION BY {_category} ORDER BY {_newest}) AS rank, id FROM ({_recent})) WHERE rank <= 10",
)
_sh, _wh = V.sql_host("source_url"), V.sql_host("website_url")
_off = f"coalesce({_sh} = {_wh} OR ends_with({_sh}, '.' || {_wh}) OR ends_with({_wh}, '.' || {_sh}), false)"
_add(
    "t3_watch_lists", lambda s, d: topk.watch_lists(_recently(s, d)).select("watch", "rank", "id"),
    f"SELECT * FROM (SELECT watch, row_number() OVER (PARTITION BY watch ORDER BY {_newest}) AS rank, id FROM (SELECT *, CASE WHEN {_off} THEN 'active' ELSE 'passive' END AS watch FROM ({_recent}))) WHERE rank <= 10",
)
_add("t4_page", lambda s, d: topk.page(V.suppliers(s, d), [F.col("name"), F.col("entity_id")], 2, 10).select("entity_id", "name"), "SELECT entity_id, name FROM v_supplier ORDER BY name, entity_id LIMIT 10 OFFSET 10")
_add(
    "t5_latest_per_org", lambda s, d: topk.latest_per_org(V.events(s, d), 3).select("organization_id", "rank", "id"),
    f"SELECT * FROM (SELECT organization_id, row_number() OVER (PARTITION BY organization_id ORDER BY {_newest}) AS rank, id FROM v_event ) WHERE rank <= 3",
)
_add(
    "t6_event_context", lambda s, d: topk.event_context(V.events(s, d)).select("organization_id", F.array_join(F.transform("context", lambda x: x["title"]), "|").alias("titles")),
    f"SELECT organization_id, string_agg(title, '|' ORDER BY rank) AS titles FROM (SELECT organization_id, title, row_number() OVER (PARTITION BY organization_id ORDER BY {_newest}) AS rank FROM v_event ) WHERE rank <= 10 GROUP BY 1",
)
_place = "row_number() OVER (PARTITION BY name ORDER BY CASE WHEN trim(coalesce(description, '')) <> '' THEN 0 ELSE 1 END, entity_id)"
_add("t8_duplicates_to_drop", lambda s, d: topk.duplicates_to_drop(V.named(s, d)).select("entity_id", "name"), f"SELECT entity_id, name FROM (SELECT *, {_place} AS k FROM v_named ) WHERE k > 1")
_add("t9_digest_events", lambda s, d: topk.digest_events(V.events(s, d)).select("id", "relevance_score"), "SELECT id, relevance_score FROM v_event ORDER BY relevance_score DESC, created_at DESC, id LIMIT 60")
_add("t12_keyset_page", lambda s, d: topk.keyset_page(V.events(s, d), "id", 20, 15).select("id"), "SELECT id FROM v_event WHERE id > 20 ORDER BY id LIMIT 15")
_add(
    "t15_recent_turns", lambda s, d: topk.recent_turns(V.table(s, d, "conversations"), 4, 50),
    """SELECT conv_id, turn, role, substr(text, 1, 50) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations
        WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '') WHERE k <= 4""",
)
_add("t16_sort_locale", lambda s, d: topk.sort_names(V.pages(s, d).select("page_id", T.page_title(F.col("html")).alias("title")), "title", "UNICODE"), "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM v_page")
_add("t16_sort_names", lambda s, d: topk.sort_names(V.suppliers(s, d), "name").select("name", "country"), "SELECT name, country FROM v_supplier ORDER BY lower(name), name")

# Deduplication, writes. -------------------------------------------------------------------------------------------

_add(
    "d1_dedupe_last_value", lambda s, d: dedup.dedupe_last_value(V.pages(s, d).select("host", F.col("page_id").alias("pos"), "url"), ["host"]),
    "SELECT host, min(page_id) AS pos, max_by(url, page_id) AS url FROM v_page GROUP BY host",
)
_add("d4_dedupe_names", lambda s, d: dedup.dedupe_names(V.named(s, d).withColumn("pos", _number())), "SELECT min_by(name, k) AS name, min(k) AS pos FROM (SELECT name, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named ) GROUP BY trim(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'))")
_add("d5_distinct_ordered", lambda s, d: dedup.distinct_ordered(V.pages(s, d), "host", "page_id"), "SELECT host, min(page_id) AS page_id FROM v_page GROUP BY host")
_title_key = "regexp_replace(lower(title), '[\\s\\p{P}\\p{S}_]+', '', 'g')"
_alike = lambda u, k: f"(coalesce(list_contains(us, {u}), false) OR ({k} <> '' AND len(list_filter(ks, lambda x: contains(x, {k}) OR contains({k}, x))) > 0))"
_add(
    "d3_dedupe_titles", lambda s, d: dedup.dedupe_titles(V.events(s, d)).select("id", "organization_id", "title"),
    f"""SELECT id, organization_id, title FROM (WITH RECURSIVE c AS (SELECT id, organization_id, {_title_key} AS k, {_canonical} AS u, row_number() OVER (PARTITION BY organization_id ORDER BY relevance_score DESC, id) AS i
            FROM (SELECT *, source_url AS url FROM v_event)),
        r(organization_id, i, ids, ks, us) AS (SELECT organization_id, 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[] FROM c GROUP BY 1
            UNION ALL SELECT c.organization_id, c.i, CASE WHEN keep THEN list_append(ids, id) ELSE ids END, CASE WHEN keep AND k <> '' THEN list_append(ks, k) ELSE ks END, CASE WHEN keep AND u IS NOT NULL THEN list_append(us, u) ELSE us END
            FROM (SELECT r.ids, r.ks, r.us, c.*, len(ids) < 10 AND NOT {_alike('c.u', 'c.k')} AS keep FROM r JOIN c ON c.organization_id = r.organization_id AND c.i = r.i + 1) c)
        SELECT e.id, e.organization_id, e.title FROM v_event e WHERE e.id IN (SELECT unnest(ids) FROM (SELECT arg_max(ids, i) AS ids FROM r GROUP BY organization_id)))""",
)
_add(
    "d8_plan_org_cleanup", lambda s, d: dedup.plan_org_cleanup(V.named(s, d), V.named_events(s, d)),
    f"""WITH shell AS (SELECT entity_id, name FROM v_named WHERE trim(coalesce(website_url, '')) = '' AND length(trim(coalesce(description, ''))) < 10 AND entity_id NOT IN (SELECT organization_id FROM v_named_event ))
        SELECT entity_id, name, 'shell' AS rule FROM shell UNION ALL
        SELECT entity_id, name, 'duplicate' FROM (SELECT *, {_place} AS k FROM v_named WHERE entity_id NOT IN (SELECT entity_id FROM shell)) WHERE k > 1""",
)
_add(
    "w1_upsert",
    lambda s, d: writes.upsert(V.named(s, d).where(_number() % 2 == 0), V.named(s, d).where(_number() % 3 == 0).withColumn("name", F.upper("name")).withColumn("description", F.lit("new")).withColumn("pos", F.lit(1)), ["entity_id"], ["name"]).select("entity_id", "name", "description"),
    """SELECT entity_id, CASE WHEN k % 3 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN k % 2 = 0 THEN description ELSE 'new' END AS description
        FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named ) WHERE k % 2 = 0 OR k % 3 = 0""",
)
_add(
    "w2_insert_ignore",
    lambda s, d: writes.insert_ignore(V.named(s, d).where(_number() % 2 == 0), V.named(s, d).withColumn("pos", _number()), ["name"]).select("entity_id", "name"),
    """WITH t AS (SELECT entity_id, name FROM v_named WHERE CAST(substr(entity_id, 5) AS BIGINT) % 2 = 0) SELECT * FROM t UNION ALL
        SELECT min_by(entity_id, CAST(substr(entity_id, 5) AS BIGINT)), name FROM v_named WHERE name NOT IN (SELECT name FROM t) GROUP BY name""",
)
_add("w4_delete_cascade", lambda s, d: writes.delete_with_events(V.named(s, d), V.named_events(s, d), topk.duplicates_to_drop(V.named(s, d)))[1].select("id"), f"SELECT id FROM v_named_event WHERE organization_id NOT IN (SELECT entity_id FROM (SELECT *, {_place} AS k FROM v_named ) WHERE k > 1)")
_add(
    "w5_rename_if_unchanged",
    lambda s, d: writes.rename_if_unchanged(V.named(s, d), V.named(s, d).select("entity_id", F.when(_number() % 2 == 0, F.col("name")).otherwise("gone").alias("old_name"), F.lit("renamed").alias("new_name"))).select("entity_id", "name"),
    "SELECT entity_id, CASE WHEN CAST(substr(entity_id, 5) AS BIGINT) % 2 = 0 THEN 'renamed' ELSE name END AS name FROM v_named",
)
_add(
    "w9_chunk_lines", lambda s, d: writes.chunk_lines(_docs(s, d).select("doc_id", "text"), F.col("text"), 500).select("doc_id", "piece_no", "piece", "oversize"),
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        r(doc_id, i, piece_no, piece) AS (SELECT doc_id, i, 0, line FROM l WHERE i = 1
            UNION ALL SELECT l.doc_id, l.i, CASE WHEN strlen(piece) + 1 + strlen(line) <= 500 THEN piece_no ELSE piece_no + 1 END, CASE WHEN strlen(piece) + 1 + strlen(line) <= 500 THEN piece || chr(10) || line ELSE line END
            FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
        SELECT doc_id, CAST(piece_no AS INTEGER) AS piece_no, arg_max(piece, i) AS piece, strlen(arg_max(piece, i)) > 500 AS oversize FROM r GROUP BY doc_id, piece_no""",
)

# Cleaning, health. ------------------------------------------------------------------------------------------------

_add("c1_plan_content_cleanup", lambda s, d: cleaning.plan_content_cleanup(V.orgs(s, d), V.events(s, d)))
_add("c2_apply_org_cleanup", lambda s, d: cleaning.apply_org_cleanup(V.named(s, d), V.named_events(s, d))[0].select("entity_id", "name"),
    f"SELECT entity_id, name FROM v_named WHERE entity_id NOT IN (SELECT entity_id FROM ({SQL['d8_plan_org_cleanup']}))",
)
_add("c3_plan_deep_clean", lambda s, d: cleaning.plan_deep_clean(V.named(s, d).withColumn("website_url", F.when(_number() % 5 == 0, F.concat(F.lit("https://p"), "slug", F.lit(".medium.com/blog/x"))).otherwise(F.col("website_url"))).withColumn("website_url", F.replace("website_url", F.lit("Brand#"), F.lit("b"))).withColumn("description", F.concat("description", F.when(_number() % 7 == 0, F.lit(" cookie 登录 and more of it")).otherwise(F.lit(" and other things")))), V.named_events(s, d)).withColumns({c: F.array_join(c, ",") for c in ("website_rules", "summary_rules")}))
_add(
    "c4_plan_event_cleanup", lambda s, d: cleaning.plan_event_cleanup(V.events(s, d), V.events(s, d).where("id % 2 = 0").select("id", (F.col("id") % 9 + 1).alias("score"))),
    f"""SELECT id, action, CASE WHEN action = 'update' THEN n END AS score FROM (SELECT id, n, CASE WHEN {_garbage} THEN 'delete_rule' WHEN relevance_score < 6 AND n >= 6 THEN 'update' WHEN relevance_score < 6 AND n < 6 THEN 'delete_score' WHEN relevance_score < 6 THEN 'keep' END AS action
        FROM (SELECT *, CASE WHEN id % 2 = 0 THEN id % 9 + 1 END AS n FROM v_event )) WHERE action IS NOT NULL""",
)
_add(
    "k1_health_class", lambda s, d: V.fetches(s, d).select("fetch_id", health.health_class(F.col("status"), F.col("error_code"))["retry_class"].alias("retry_class")),
    f"SELECT fetch_id, {_class} AS retry_class FROM v_fetch",
)
_add(
    "k3_source_state", lambda s, d: health.source_state(V.fetches(s, d)).select("source_id", "status", "retry_class", "failure_count", "success_count"),
    f"SELECT source_id, status, {_class} AS retry_class, failure_count, success_count FROM ({_state})",
)
_add("k4_admit", lambda s, d: health.admit(V.fetches(s, d).select("source_id", "ts", "fetch_id"), "source_id", "ts", 20, 3600),
    """SELECT * FROM (WITH RECURSIVE w(source_id, opened) AS (SELECT source_id, min(ts) FROM v_fetch GROUP BY 1
        UNION SELECT w.source_id, min(f.ts) FROM w JOIN v_fetch f ON f.source_id = w.source_id AND f.ts >= w.opened + INTERVAL 1 HOUR GROUP BY w.source_id, w.opened)
        SELECT f.source_id, f.ts, fetch_id, row_number() OVER (PARTITION BY f.source_id, opened ORDER BY f.ts, fetch_id) <= 20 AS admitted
        FROM v_fetch f JOIN w ON w.source_id = f.source_id AND f.ts >= opened AND f.ts < opened + INTERVAL 1 HOUR)""",
)
_add("k6_pending", lambda s, d: health.pending(V.pages(s, d), V.pages(s, d).where("page_id % 3 = 0"), "page_id").select("page_id"), "SELECT page_id FROM v_page WHERE page_id % 3 <> 0")

_users = lambda s, d: V.table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("updated_at")).select(F.col("conv_id").alias("id"), (F.col("conv_id") % 7).alias("user_id"), "updated_at", F.when(F.col("conv_id") % 5 == 0, "gone").alias("revoked_at"))
_add(
    "t15_session_list", lambda s, d: topk.session_list(_users(s, d), 10).select("user_id", "id", "rank"),
    "SELECT conv_id % 7 AS user_id, conv_id AS id, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY n DESC, conv_id) AS rank FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) WHERE conv_id % 5 <> 0 QUALIFY rank <= 10",
)
_failures = {0: "request timed out", 1: "fetch failed", 2: "llm_parse_failed", 3: "no valid source", 4: "odd"}
_reasons = {0: "network_timeout", 1: "network_error", 2: "llm_parse_failed", 3: "no_valid_source", 4: "processing_failed"}
_told = lambda s, d: V.pages(s, d).select(F.col("page_id").alias("entity_id"), F.element_at(F.create_map(*[F.lit(x) for kv in _failures.items() for x in kv]), (F.col("page_id") % 6).cast("int")).alias("error"))
_cases = lambda c: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _reasons.items()) + " END"
_add("g10_run_manifest", lambda s, d: stats.run_manifest(_told(s, d)), f"SELECT CASE WHEN page_id % 6 = 5 THEN 'success' ELSE 'failed' END AS list, page_id AS entity_id, {_cases('page_id % 6')} AS reason FROM pages")
_add(
    "q3_institution_query", lambda s, d: V.events(s, d).select("id", P.institution_query(F.concat(F.when(F.col("id") % 2 == 0, "请问 北京测试大学").otherwise(""), F.lit(" "), F.col("title"), F.lit("?"))).alias("value")),
    "SELECT id, CASE WHEN id % 2 = 0 THEN '北京测试大学' ELSE trim(substr(trim(regexp_replace(title || '?', '[？?。！!，,；;：:]', ' ', 'g')), 1, 200)) END AS value FROM v_event",
)

# Extraction, matching, model exchange. ----------------------------------------------------------------------------

_html = V.pages
_own_entities = lambda c: __import__("functools").reduce(lambda x, kv: f"replace({x}, '{kv[0]}', '{kv[1].replace(chr(39), chr(39) * 2)}')", extract.ENTITIES.items(), c)
_tagless = lambda c: f"trim(regexp_replace({_own_entities(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))"
_anchor = "'(?is)<a\\b[^<>]*?\\bhref\\s*=\\s*[\"'']([^\"''<>]+)[\"''][^<>]*>(.*?)</a>'"
_origin = f"lower({_p[1]}) || '://' || lower({_p[3]}) || CASE WHEN {_p[4]} <> '' THEN ':' || {_p[4]} ELSE '' END"
_meta_html = """CASE WHEN page_id % 3 = 0 THEN html ELSE replace(html, '</head>', '<meta content="' || substr(host, 1, 9) || ' &amp; more" name="Description"><META property=''og:description'' content='''
    || CASE WHEN page_id % 5 = 0 THEN '' ELSE url END || '''><meta property="og:title" content="' || host || '"></head>') END"""
_add(
    "x5_article_details", lambda s, d: extract.article_details(_html(s, d).withColumn("html", _with_meta())).select("url", "title", "summary", "published"),
    f"""SELECT url, CASE WHEN page_id % 3 <> 0 THEN host WHEN h <> '' THEN h ELSE nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') END AS title,
        CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN url ELSE list_filter(p, lambda x: length(x) BETWEEN 80 AND 1200 AND NOT regexp_matches(x, '(?i)cookie|privacy|隐私'))[1] END AS summary, CAST(NULL AS VARCHAR) AS published
        FROM (SELECT *, {_tagless("regexp_extract(html, '(?is)<h1\\b[^<>]*>(.*?)</h1>', 1)")} AS h, list_transform(regexp_extract_all(html, '(?is)<p\\b[^<>]*>(.*?)</p>', 1), lambda x: {_tagless('x')}) AS p FROM v_page)""",
)
_deeper = lambda s, d: _html(s, d).select("url", F.replace("html", F.lit('href="/'), F.lit('href="/news/')).alias("html"))
_add(
    "x8_article_link_count", lambda s, d: extract.article_link_count(_deeper(s, d)),
    f"""SELECT url, CAST(least(count(DISTINCT link), 20) AS BIGINT) AS n FROM (SELECT url, CASE WHEN lower({_p[1]}) = 'https' AND length(t) BETWEEN 7 AND 260 AND regexp_matches(h || ' ' || t, '{extract.ARTICLE_HINT}') THEN {_origin} || h END AS link
        FROM (SELECT url, h, {_tagless('t')} AS t FROM (SELECT url, unnest([''] || regexp_extract_all(html, {_anchor}, 1)) AS h, unnest([''] || regexp_extract_all(html, {_anchor}, 2)) AS t FROM (SELECT url, replace(html, 'href="/', 'href="/news/') AS html FROM v_page)))) GROUP BY url""",
)
_add(
    "x10_locate_news_page",
    lambda s, d: extract.locate_news_page(
        _html(s, d).groupBy(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), F.col("url").alias("endpoint")).agg(F.min("page_id").alias("rank")).withColumn("source_type", F.element_at(F.array(*[F.lit(x) for x in ("html", "rss", "sitemap", "json")]), (F.col("rank") % 4 + 1).cast("int"))),
        _html(s, d).groupBy("url").agg((F.min("page_id") % 3).alias("n"), F.when(F.min("page_id") % 2 == 0, "Latest").alias("title")).union(_html(s, d).select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), (F.length("host") % 4).cast("long").alias("n"), F.lit(None).cast("string").alias("title")).distinct()),
    ),
    f"""WITH e AS (SELECT 'https://' || host || '/' AS url, url AS endpoint, min(page_id) AS rank FROM v_page GROUP BY 1, 2),
        c AS (SELECT url, min(page_id) % 3 AS n, CASE WHEN min(page_id) % 2 = 0 THEN 'Latest' ELSE '' END AS title FROM v_page GROUP BY 1),
        f AS (SELECT e.url, arg_min(endpoint, rank) AS endpoint FROM e JOIN c ON c.url = e.endpoint WHERE CASE WHEN rank % 4 = 0 THEN n >= 2 OR (n >= 1 AND regexp_matches(endpoint || ' ' || title, '{extract.NEWS_HINT}')) ELSE n >= 1 END GROUP BY 1)
        SELECT DISTINCT e.url, coalesce(f.endpoint, CASE WHEN length(e.url) % 4 >= 2 THEN e.url END) AS news_page FROM (SELECT url, url AS u FROM e) e LEFT JOIN f ON f.url = e.url""".replace("length(e.url) % 4", "(length(e.url) - 9) % 4"),
)
_article = f"regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article\\b[^<>]*>(.*)</article>', 1), '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_add(
    "x4_snippet_fallback", lambda s, d: extract.with_snippet_fallback(extract.first_articles(_html(s, d), "page_id"), V.events(s, d).select(F.col("source_url").alias("url"), "title", "summary")).select("url", "title", "confidence"),
    f"""SELECT source_url AS url, CASE WHEN n >= 120 THEN a.title ELSE e.title END AS title, CAST(CASE WHEN n >= 120 THEN 0.65 ELSE 0.2 END AS DOUBLE) AS confidence FROM v_event e
        LEFT JOIN (SELECT url, length({_plain(_article, '')}) AS n, {_plain("regexp_extract(html, '(?is)<h1\\b[^<>]*>(.*?)</h1>', 1)", '')} AS title FROM v_page QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) a ON a.url = e.source_url""",
)


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each page: RSS, Atom, a sitemap, a list in JSON, or the page itself."""
    site = F.concat(F.lit("https://"), "host")
    rss = F.concat(F.lit("<rss><item><title><![CDATA[News "), "page_id", F.lit("]]></title><link>"), site, F.lit("/n/1</link></item><item><title>Two &amp; <b>three</b></title><link>/rel/"), "page_id", F.lit("</link></item><item><title>x</title><link>https://other.invalid/1</link></item></rss>"))
    atom = F.concat(F.lit('<feed><entry><title type="text"></title><link rel="alternate" href="'), site, F.lit('/e/1#top"/></entry><entry><title>Second</title><link href="../e/2"/></entry></feed>'))
    urls = F.concat(F.lit("<urlset><url><loc> "), site, F.lit("/s/1\n</loc></url><url><loc>"), site, F.lit("/s/2?a=1&amp;b="), "page_id", F.lit("</loc></url><url><loc>https://other.invalid/</loc></url></urlset>"))
    listed = F.concat(F.lit('{"items":[{"url":"'), site, F.lit('/j/1","title":"One"},{"link":"/j/2","title":{"rendered":"Two"}},{"link":"mailto:x"}]}'))
    kind = (F.col("page_id") % 5).cast("int")
    told = F.element_at(F.array(rss, atom, urls, listed, F.col("html")), kind + 1)
    return _html(spark, d).select(F.concat(site, F.lit("/feed/"), "page_id", F.lit(".xml")).alias("url"), F.element_at(F.array(*[F.lit(x) for x in ("rss", "rss", "sitemap", "json", "html")]), kind + 1).alias("source_type"), told.alias("text")).withColumn("url", F.when(F.col("source_type") == "html", F.regexp_replace("url", r"\.xml$", "")).otherwise(F.col("url")))


_add(
    "x7_feed_articles", lambda s, d: extract.feed_articles(_feeds(s, d)),
    f"""WITH p AS (SELECT page_id, page_id % 5 AS k, 'https://' || host AS s, html FROM v_page),
        f AS (SELECT *, s || '/feed/' || page_id || CASE WHEN k = 4 THEN '' ELSE '.xml' END AS url FROM p)
        SELECT url, CAST(pos AS INTEGER) AS pos, link, CASE WHEN title <> '' THEN title ELSE link END AS title FROM (
            SELECT url, 0 AS pos, s || '/n/1' AS link, 'News ' || page_id AS title FROM f WHERE k = 0 UNION ALL SELECT url, 1, s || '/rel/' || page_id, 'Two & three' FROM f WHERE k = 0
            UNION ALL SELECT url, 0, s || '/e/1', '' FROM f WHERE k = 1 UNION ALL SELECT url, 1, s || '/e/2', 'Second' FROM f WHERE k = 1
            UNION ALL SELECT url, 0, s || '/s/1', s || '/s/1' FROM f WHERE k = 2 UNION ALL SELECT url, 1, s || '/s/2?a=1&b=' || page_id, s || '/s/2?a=1&b=' || page_id FROM f WHERE k = 2
            UNION ALL SELECT url, 0, s || '/j/1', 'One' FROM f WHERE k = 3 UNION ALL SELECT url, 1, s || '/j/2', 'Two' FROM f WHERE k = 3
            UNION ALL SELECT url, i, s || h, {_tagless('t')} FROM (SELECT url, s, unnest(regexp_extract_all(html, {_anchor}, 1)) AS h, unnest(regexp_extract_all(html, {_anchor}, 2)) AS t, unnest(range(len(regexp_extract_all(html, {_anchor}, 1)))) AS i FROM f WHERE k = 4))""",
)
_add("x3_extract_articles", lambda s, d: extract.extract_articles(_html(s, d)).withColumn("contents", F.to_json("contents")))
_add("x6_news_endpoints", lambda s, d: extract.news_endpoints(_html(s, d).select("url", "html"), ["newsroom"]))
_add("x13_extract_names", lambda s, d: extract.extract_names(_docs(s, d).withColumn("text", F.regexp_replace("text", r"\.\s", " University, ")), "doc_id", "text"))
_add(
    "x14_context_body", lambda s, d: _docs(s, d).select("doc_id", cleaning.context_body(F.col("text"), 600).alias("body")),
)
_entities = lambda s, d: match.entity_identity(V.orgs(s, d)).withColumn("badge", F.length("slug") % 2 == 0)
_hits = lambda s, d: V.events(s, d).select(F.col("organization_id").alias("entity_id"), F.col("id").alias("pos"), F.col("source_url").alias("url"), "title", F.col("summary").alias("snippet"))
_scored = lambda s, d: match.score_candidates(_hits(s, d).join(_entities(s, d), "entity_id"))
_add("m5_score_candidates", lambda s, d: _scored(s, d).select("entity_id", "pos", "pre_score"))
_pages_scored = lambda s, d: match.score_identity(_scored(s, d).withColumn("page_url", F.col("url")).withColumn("page_text", F.concat_ws(" ", "title", "snippet")).withColumn("context", F.array(F.lit("the"), F.lit("de"))))
_add("m6_score_identity", lambda s, d: _pages_scored(s, d).select("entity_id", "pos", "identity_score", "host_matches", "context_matches"))
_add("m7_accept_candidates", lambda s, d: match.accept_candidates(_pages_scored(s, d).withColumn("registered", F.lit(False))).select("entity_id", "pos", "confidence"))
_add("t10_best_candidate", lambda s, d: topk.select_best_candidate(match.accept_candidates(_pages_scored(s, d).withColumn("registered", F.lit(True)), 0, 0)))
_add("m10_domain_candidates", lambda s, d: match.domain_candidates(_entities(s, d)))
_reviewed = lambda s, d: _hits(s, d).withColumn("confidence", (F.col("pos") * 7 % 101).cast("int"))
_add(
    "m8_apply_reviews",
    lambda s, d: match.apply_reviews(_reviewed(s, d), _hits(s, d).select("entity_id", "url", (F.col("pos") % 3 > 0).alias("is_official"), (F.col("pos") * 3 % 101).cast("int").alias("score"), (F.col("pos") % 7 == 0).alias("has_conflicts"))).select("entity_id", "pos", "confidence"),
    """SELECT organization_id AS entity_id, id AS pos, least(100, greatest(72, floor((c + s) / 2.0 + 0.5))) AS confidence FROM (SELECT e.organization_id, e.id, e.id * 7 % 101 AS c, r.s, row_number() OVER (PARTITION BY e.organization_id ORDER BY e.id, e.source_url) AS p
        FROM v_event e JOIN (SELECT organization_id, source_url, max(id * 3 % 101) AS s FROM v_event WHERE id % 3 > 0 AND id * 3 % 101 >= 85 AND id % 7 <> 0 GROUP BY 1, 2) r USING (organization_id, source_url) WHERE e.id * 7 % 101 >= 50) WHERE p = 1""",
)
_q = "CASE WHEN regexp_matches(name, '[\\x{4E00}-\\x{9FFF}]') THEN [name || ' 新闻', name || ' 动态'] ELSE [name || ' news', name || ' announcement'] END"
_add(
    "m11_search_queries", lambda s, d: match.search_queries(V.orgs(s, d)),
    f"""SELECT entity_id, CAST(i - 1 AS INTEGER) AS pos, q[i] AS query FROM (SELECT entity_id, {_q} || CASE WHEN website_url IS NOT NULL THEN ['site:' || {_wh}] ELSE [] END AS q FROM v_org ), range(1, 4) r(i) WHERE i <= len(q)""",
)
_fetched = lambda s, d: _html(s, d).select(F.concat(F.lit("org-"), "host").alias("entity_id"), "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html")
_add("m3_verify_homepages", lambda s, d: match.verify_homepages(_fetched(s, d), V.orgs(s, d).withColumn("aliases", F.lit(None).cast("array<string>"))))
_decided = lambda s, d: match.decide_official(V.orgs(s, d), V.orgs(s, d).where("length(slug) % 5 = 0").select("entity_id", F.col("slug").alias("domain")), _hits(s, d).withColumn("accepted", F.col("pos") % 2 == 0), V.orgs(s, d).where("length(slug) % 7 = 0").select("entity_id", F.col("slug").alias("domain")))
_add(
    "m9_candidates", lambda s, d: _decided(s, d).select("entity_id", F.array_join("candidates", " ").alias("candidates")),
    """SELECT entity_id, CASE WHEN length(slug) % 5 = 0 THEN '' ELSE coalesce(c, '') END AS candidates FROM v_org LEFT JOIN (SELECT organization_id AS o, string_agg(source_url, ' ' ORDER BY n) AS c
        FROM (SELECT organization_id, source_url, row_number() OVER (PARTITION BY organization_id ORDER BY min(id), source_url) AS n FROM v_event WHERE source_url IS NOT NULL GROUP BY 1, 2) WHERE n <= 8 GROUP BY 1) ON o = entity_id""",
)
_add(
    "m11_official_site_query",
    lambda s, d: match.official_site_query(match.context_tokens(V.suppliers(s, d).withColumn("name", F.when(F.col("entity_id") % 3 == 0, F.concat(F.lit("测试大学"), F.col("entity_id").cast("string"))).otherwise(F.concat("name", F.lit(" （测试）")))).select("entity_id", "name", F.when(F.col("entity_id") % 4 == 0, "人物").otherwise("高校").alias("entity_type"), F.when(F.col("entity_id") % 5 == 0, "university").alias("route_kind"), F.when(F.col("entity_id") % 2 == 0, "未标注").otherwise(F.col("country")).alias("city"), "region", F.lit("alpha beta 中文词 gamma delta").alias("summary")))),
    """SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN '测试大学' || entity_id || ' alpha beta 中文词' ELSE replace(name, '#', '#') || ' alpha beta gamma' END || ' ' || CASE WHEN entity_id % 2 = 0 THEN region ELSE country END || ' '
        || CASE WHEN entity_id % 3 = 0 THEN '官网' WHEN entity_id % 4 = 0 THEN 'official profile' WHEN entity_id % 5 = 0 THEN 'official website research news technology transfer' ELSE 'official website news press release' END AS query FROM v_supplier""",
)
_add(
    "m9_decide_official",
    lambda s, d: _decided(s, d).select("entity_id", "domain", "status"),
)
_requests = lambda s, d: V.events(s, d).select("organization_id", F.col("id").alias("pos"), "title", F.col("source_url").alias("url"), "summary", F.lit(None).cast("string").alias("llm_context"), F.when(F.col("id") % 2 == 0, "full-text").otherwise("snippet-fallback").alias("extraction_method"))
_add("l1_build_requests", lambda s, d: model_io.build_event_requests(_requests(s, d)),
    """SELECT organization_id, '{"candidates":[' || string_agg('{"title":' || to_json(title) || ',"url":' || to_json(source_url) || ',"content":' || to_json(CASE WHEN id % 2 = 0 THEN '[FULL TEXT] ' ELSE '[SNIPPET MODE - LIMITED INFO] ' END || coalesce(summary, '')) || '}', ',' ORDER BY id) || ']}' AS request
        FROM v_event GROUP BY 1""",
)


_add(
    "l8_parse_translation", lambda s, d: V.events(s, d).select("id", model_io.parse_translation(F.when(F.col("id") % 3 > 0, F.to_json(F.struct(F.lower("title").alias("title"), F.when(F.col("id") % 2 == 0, "told").alias("description")))), F.col("title"), F.col("summary")).alias("t")).select("id", "t.*"),
    "SELECT id, CASE WHEN id % 3 > 0 AND trim(title) <> '' THEN trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) ELSE title END AS title, CASE WHEN id % 3 > 0 AND id % 2 = 0 THEN 'told' ELSE summary END AS description FROM v_event",
)
_add(
    "j10_join_llm_items",
    lambda s, d: joins.join_llm_items(V.events(s, d).select("organization_id", F.concat("source_url", F.lit("/")).alias("url"), "id"), _hits(s, d).where("pos % 3 > 0").withColumnRenamed("entity_id", "organization_id")).select("organization_id", "id", "candidate_pos"),
    f"""SELECT e.organization_id, e.id, min(c.id) AS candidate_pos FROM (SELECT *, {_canonical.replace('url', "(source_url || '/')")} AS u FROM v_event ) e
        JOIN (SELECT *, {_su} AS u FROM v_event ) c ON c.organization_id = e.organization_id AND c.u = e.u AND c.id % 3 > 0 GROUP BY 1, 2""",
)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of several shapes, made of the events themselves: each is about at most 1,000 events of an organization,
    as a request has so many candidates and not all that the organization ever had."""
    item = F.struct("title", "summary", F.col("source_url").alias("url"), "relevance_score", F.when(F.col("id") % 3 == 0, F.col("event_date")).alias("event_date"), F.lit("report").alias("event_type"))
    listed = V.events(spark, d).where("title <> '' and summary <> ''").groupBy("organization_id", F.floor(F.col("id") / 1000)).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("j"))
    n, j = F.length("organization_id") % 4, F.col("j")
    return listed.select("organization_id", F.when(n == 0, j).when(n == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```"))).when(n == 2, F.concat(F.lit("I found "), j, F.lit(" in all."))).otherwise(F.concat(F.lit('{"candidates":'), j, F.lit("}"))).alias("response"))


_add(
    "l2_parse_responses", lambda s, d: model_io.parse_event_responses(_answers(s, d)).select("organization_id", "title", "url", "relevance_score"),
    "SELECT organization_id, title, source_url AS url, relevance_score FROM v_event WHERE title <> '' AND summary <> ''",
)
_add(
    "l4_score_filter",
    lambda s, d: model_io.score_filter(model_io.parse_event_responses(_answers(s, d)), _hits(s, d).withColumnRenamed("entity_id", "organization_id"), "2024-01-20", 36500, 5).select("organization_id", "title", "url", "relevance_score"),
    "SELECT organization_id, title, source_url AS url, relevance_score FROM v_event WHERE title <> '' AND summary <> '' AND relevance_score >= 5 AND NOT regexp_matches(title || ' ' || summary, '(?i)登录|注冊|注册|广告|cookie|404')",
)
_add("l9_ingest_events", lambda s, d: model_io.ingest_events(model_io.parse_event_responses(_answers(s, d)), _hits(s, d).withColumnRenamed("entity_id", "organization_id"), V.events(s, d).where("id % 5 = 0").withColumn("id", F.col("id").cast("string")), "2024-01-20", 36500).select("id", "organization_id", "source_url", "relevance_score"))
_add("k2_next_times", lambda s, d: V.fetches(s, d).select("fetch_id", health.next_times(health.health_class(F.col("status"), F.col("error_code"))["health"], F.col("ts").cast("timestamp_ntz")).alias("n")).select("fetch_id", F.date_format("n.next_check_at", "yyyy-MM-dd HH:mm:ss").alias("next_check_at")), f"SELECT fetch_id, strftime(CASE WHEN status = 403 THEN TIMESTAMP '9999-12-31 00:00:00' WHEN status = 404 THEN ts + INTERVAL 7 DAY WHEN status = 429 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS next_check_at FROM v_fetch")
_add(
    "b2_render_digest", lambda s, d: cleaning.render_digest(topk.digest_events(joins.events_with_org(V.events(s, d), V.orgs(s, d), "inner"), 20)),
    f"""SELECT string_agg(k || '. [' || organization_name || '] ' || title || chr(10) || source_url, chr(10) ORDER BY k) AS digest, count(*) AS n
        FROM (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, id) AS k FROM (SELECT * FROM ({_joined}) ORDER BY relevance_score DESC, created_at DESC, id LIMIT 20))""",
)
_add(
    "g13_cleaning_diff", lambda s, d: cleaning.cleaning_diff(V.named(s, d), _renamed(s, d)).select("entity_id", "outcome"),
    f"""SELECT entity_id, CASE WHEN name <> new THEN 'corrected' WHEN regexp_matches(new, '^[A-Za-z][A-Za-z\\s''-]{{2,39}}$') OR regexp_matches(new, '(?i)\\b({'|'.join(P.ENTITY_WORDS)})\\b') THEN 'valid' ELSE 'invalid_or_failed' END AS outcome
        FROM (SELECT entity_id, name, CASE WHEN CAST(substr(entity_id, 5) AS BIGINT) % 7 = 0 THEN upper(name) ELSE name END AS new FROM v_named )""",
)
_add(
    "g14_plan_summary", lambda s, d: stats.plan_summary(dedup.plan_org_cleanup(V.named(s, d), V.named_events(s, d)), V.named_events(s, d)),
    f"""WITH shell AS (SELECT entity_id FROM v_named WHERE trim(coalesce(website_url, '')) = '' AND length(trim(coalesce(description, ''))) < 10 AND entity_id NOT IN (SELECT organization_id FROM v_named_event )),
        plan AS (SELECT entity_id, 'shell' AS rule FROM shell UNION ALL SELECT entity_id, 'duplicate' FROM (SELECT *, {_place} AS k FROM v_named WHERE entity_id NOT IN (SELECT entity_id FROM shell)) WHERE k > 1)
        SELECT rule, count(*) AS n, CAST(sum(coalesce(c, 0)) AS BIGINT) AS events FROM plan LEFT JOIN (SELECT organization_id, count(*) AS c FROM v_named_event GROUP BY 1) ON organization_id = entity_id GROUP BY rule""",
)
_tagged = lambda s, d: V.named(s, d).select("entity_id", F.element_at(F.array(*[F.lit(x) for x in cleaning.TAG_PRIORITY]), (_number() % 4 + 1).cast("int")).alias("status"), F.col("slug").alias("detail")).union(V.named(s, d).select("entity_id", F.lit("corrected"), F.lit("z")))
_add(
    "a2_resolve_tags", lambda s, d: cleaning.resolve_tags(_tagged(s, d)),
    "SELECT entity_id, list_extract(['needs_retry', 'invalid_name', 'rejected_hallucination', 'corrected'], CAST(substr(entity_id, 5) AS BIGINT) % 4 + 1) AS cleaning_status, slug || '; z' AS audit_note FROM v_named",
)
_add(
    "j11_match_audit_names", lambda s, d: joins.match_audit_names(V.suppliers(s, d).withColumn("original_name", F.lit(None).cast("string")), V.suppliers(s, d).select(F.when(F.col("entity_id") % 2 == 0, F.col("name")).otherwise(F.lower("name")).alias("name"))),
    "SELECT CASE WHEN entity_id % 2 = 0 THEN name ELSE lower(name) END AS name, entity_id, CASE WHEN entity_id % 2 = 0 THEN 'exact' ELSE 'normalized' END AS tier FROM v_supplier",
)
_add("j15_profiles", lambda s, d: joins.organization_profile(V.orgs(s, d), V.events(s, d), _html(s, d).select(F.col("host").alias("organization_slug"), F.col("page_id").cast("string").alias("name"), "url")).select("entity_id", F.size("events").alias("n_events"), F.size("sources").alias("n_sources")), "SELECT entity_id, CAST(least(n, 100) AS INTEGER) AS n_events, CAST(n AS INTEGER) AS n_sources FROM v_org JOIN (SELECT host, count(*) AS n FROM v_page GROUP BY 1) ON host = slug")
_bare = f"regexp_replace({_su}, '/+$', '')"
_add(
    "d2_merge_hits", lambda s, d: dedup.merge_hits(_hits(s, d).withColumnsRenamed({"entity_id": "organization_id", "snippet": "content"})).select("organization_id", "pos", "title", "content"),
    f"""SELECT organization_id, min(id) AS pos, coalesce(min_by(title, id) FILTER (trim(title) <> ''), '') AS title, coalesce(min_by(summary, id) FILTER (trim(summary) <> ''), '') AS content
        FROM (SELECT *, {_bare} AS u FROM v_event ) WHERE u IS NOT NULL GROUP BY organization_id, u""",
)
_add("d7_stored_candidates", lambda s, d: dedup.stored_candidates(_scored(s, d).withColumn("is_official", F.col("badge")).withColumn("score", F.col("pre_score") * 2)).select("entity_id", "rank", "url", "score"))
_add("t11_rank_urls", lambda s, d: topk.rank_urls(_hits(s, d).withColumnRenamed("entity_id", "organization_id").join(V.orgs(s, d).select(F.col("entity_id").alias("organization_id"), "website_url"), "organization_id")).select("organization_id", "url", "priority", "rank"),
    f"""SELECT organization_id, url, priority, row_number() OVER (PARTITION BY organization_id ORDER BY priority, pos, url) AS rank FROM (SELECT organization_id, source_url AS url, min(id) AS pos, min(CASE
        WHEN {_sh} = {_wh} OR ends_with({_sh}, '.' || {_wh}) OR ends_with({_wh}, '.' || {_sh}) THEN 0 WHEN regexp_matches({_sh}, '(^|\\.)(gov|edu|ac)(\\.[a-z]{{2}})?$') THEN 2 WHEN regexp_matches({_sh}, '\\.org(\\.[a-z]{{2}})?$') THEN 3 ELSE 4 END) AS priority
        FROM ({_joined}) GROUP BY 1, 2)""",
)
_add(
    "t13_cap_candidates",
    lambda s, d: topk.cap_candidates(_hits(s, d).withColumnRenamed("entity_id", "organization_id").withColumn("source_rank", F.lit(0)).join(V.orgs(s, d).select(F.col("entity_id").alias("organization_id"), "website_url"), "organization_id"), 5, 2).select("organization_id", "rank", "pos"),
    f"""SELECT organization_id, rank, pos FROM (SELECT organization_id, row_number() OVER (PARTITION BY organization_id ORDER BY id) AS rank, id AS pos, website_url FROM ({_joined}))
        WHERE rank <= CASE WHEN coalesce(website_url, '') <> '' THEN 5 ELSE 2 END""",
)

# More of the inventory. -------------------------------------------------------------------------------------------

_doc_function("f25_title_of_text", lambda: F.substring(T.collapse_ws(_t()), 1, 60), "substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 60)")
_doc_function("f3_norm_ascii_han", lambda: N.norm_ascii_han(_t()), "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\x{3400}-\\x{9FFF}]+', ' ', 'g'))")
_doc_function("f4_norm_letters", lambda: N.norm_letters(_t()), "trim(regexp_replace(lower(strip_accents(regexp_replace(text, '<[^>]*>', ' ', 'g'))), '[^\\p{L}\\p{N}]+', ' ', 'g'))")
_readable = "substr(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72)"
_doc_function("f8_slug", lambda: N.slug(_t()), f"CASE WHEN {_readable} <> '' THEN {_readable} ELSE 'source-' || substr(sha256(text), 1, 16) END")
_add(
    "f12_lcs_len", lambda s, d: V.events(s, d).select("id", N.lcs_len(F.col("title"), F.col("summary")).alias("value")),
)
_add("f14_strip_tags", lambda s, d: _over(V.pages, "page_id", lambda: extract.strip_tags(F.col("html")))(s, d))
_function("f20_is_official", lambda: U.is_official(F.col("source_url"), F.lit("https://www.example.com/x")), f"coalesce({_sh} = 'example.com' OR ends_with({_sh}, '.example.com') OR ends_with('example.com', '.' || {_sh}), false)", V.events, "id", "v_event")
_add("f21_resolve_url", lambda s, d: extract.page_links(V.pages(s, d).select("page_id", "url", "html")).select("page_id", "pos", "href", "link"))
_function("f27_time_bucket", lambda: D.time_bucket(F.col("relevance_score") * 5), "CASE WHEN relevance_score * 5 <= 1 THEN 'day' WHEN relevance_score * 5 <= 7 THEN 'week' WHEN relevance_score * 5 <= 31 THEN 'month' ELSE 'year' END", V.events, "id", "v_event")
_noted = lambda: F.concat(F.lit("x; suggested_name="), F.col("title"), F.lit("; y"))
_function("f30_note_field", lambda: T.note_field(_noted(), "suggested_name"), "nullif(trim(regexp_extract('x; suggested_name=' || title || '; y', 'suggested_name=([^;|]*)', 1)), '')", V.events, "id", "v_event")
_function("f26_parse_time", lambda: F.date_format(D.parse_time(F.col("created_at")), "yyyy-MM-dd'T'HH:mm:ss"), "strftime(strptime(created_at, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S')", V.events, "id", "v_event")
_function("f28_structured_field", lambda: views.structured_field(F.to_json(F.struct("title", "summary")), "title", F.lit("none")), "CASE WHEN trim(title) <> '' THEN trim(title) ELSE 'none' END", V.events, "id", "v_event")
_function("q25_is_spam_page", lambda: P.is_spam_page(U.host(_u()), F.col("html")), "regexp_matches(host, '(^|\\.)(blog|forum|bbs|medium|wordpress|zhihu|reddit|quora)\\.') OR regexp_matches(html, '(?i)powered by wordpress|论坛|博客|讨论区|sign in to continue')")
_function("q28_content_type_ok", lambda: P.content_type_ok(F.element_at(F.array(F.lit("html"), F.lit("rss"), F.lit("api")), (F.col("page_id") % 3 + 1).cast("int")), F.lit("Text/XML; charset=utf-8")), "page_id % 3 = 1")
_sources = lambda s, d: V.suppliers(s, d).select("entity_id", "name", "country", "region", F.lit(None).cast("int").alias("source_count"), F.lit(None).cast("int").alias("mention_count"), F.when(F.col("entity_id") % 2 == 0, "success").otherwise("odd").alias("search_status"), F.lit(None).cast("string").alias("event_search_status"), F.lit(None).cast("string").alias("cleaning_status"), F.lit(None).cast("string").alias("sources"))
_add(
    "p1_organization_view", lambda s, d: views.organization_view(_sources(s, d)),
    """SELECT entity_id, name, country, region, 0 AS source_count, 1 AS mention_count, CASE WHEN entity_id % 2 = 0 THEN 'success' ELSE 'pending' END AS search_status,
        'pending' AS event_search_status, 'unreviewed' AS cleaning_status, '[]' AS sources FROM v_supplier""",
)
_add(
    "p7_normalize_input", lambda s, d: views.normalize_input(V.events(s, d).select("id", F.concat(F.lit("  "), "title").alias("title"), F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("event_type")).alias("event_type")), "events"),
    "SELECT id, trim(title) AS title, CASE WHEN id % 2 = 0 THEN 'other' ELSE event_type END AS event_type FROM v_event",
)
_add("q4_filter_core", lambda s, d: P.filter_core(V.named(s, d).withColumn("is_core_tracking", _number() % 2 == 0), True).select("entity_id"), "SELECT entity_id FROM v_named WHERE CAST(substr(entity_id, 5) AS BIGINT) % 2 = 0")
_tracked = lambda s, d: V.fetches(s, d).select("fetch_id", F.col("ts").cast("timestamp").alias("last_event_searched_at"), F.when(F.col("status") == 200, "pending").when(F.col("status") == 500, "failed").otherwise("success").alias("event_search_status"))
_add(
    "q9_due_for_search", lambda s, d: P.due_for_search(_tracked(s, d), "2024-01-15 00:00:00", 24).select("fetch_id"),
    "SELECT fetch_id FROM v_fetch WHERE status = 200 OR ts < TIMESTAMP '2024-01-14 00:00:00'",
)
_add(
    "q11_needs_translation", lambda s, d: P.needs_translation(_docs(s, d), "text", "doc_id", _docs(s, d).where("doc_id % 3 = 0"), _docs(s, d).where("doc_id % 6 = 0")).select("doc_id"),
    "SELECT doc_id FROM documents WHERE trim(text) <> '' AND (doc_id % 3 <> 0 OR doc_id % 6 = 0)",
)
_white = lambda s, d: V.suppliers(s, d).select(F.col("entity_id").alias("pos"), F.upper("name").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("array<string>").alias("aliases"), F.concat(F.lit("s"), F.col("entity_id").cast("string"), F.lit(".org")).alias("domain"))
_add("j8_match_whitelist", lambda s, d: joins.match_whitelist(V.suppliers(s, d), _white(s, d)).select("entity_id", "whitelist_domain"), "SELECT entity_id, 's' || entity_id || '.org' AS whitelist_domain FROM v_supplier")
_add(
    "j9_match_cached", lambda s, d: joins.match_cached(V.suppliers(s, d).withColumn("original_name", F.lit(None).cast("string")), V.suppliers(s, d).where("entity_id % 2 = 0").select((F.col("entity_id") + 1).alias("pos"), F.col("name"), F.lit(None).cast("bigint").alias("entity_id"), F.concat(F.lit("c"), F.col("entity_id").cast("string"), F.lit(".org")).alias("domain"))).select("entity_id", "cached_domain"),
    "SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'c' || entity_id || '.org' END AS cached_domain FROM v_supplier",
)
_results = lambda s, d: V.fetches(s, d).select("fetch_id", F.when(F.col("status") == 200, "news_verified").when(F.col("status") == 403, "official_verified").when(F.col("status") == 404, "candidate").when(F.col("status") == 429, "not_found").otherwise("failed").alias("status"))
_add(
    "g8_run_stats", lambda s, d: stats.run_stats(_results(s, d)),
    """SELECT count(*) AS total, count(*) FILTER (status IN (200, 403)) AS official_verified, count(*) FILTER (status = 200) AS news_verified, count(*) FILTER (status = 404) AS candidate,
        count(*) FILTER (status = 429) AS not_found, count(*) FILTER (status IS NULL OR status = 500) AS failed FROM v_fetch""",
)
_add(
    "g10_failure_reasons", lambda s, d: _told(s, d).where("error is not null").groupBy(stats.failure_reason(F.col("error")).alias("reason")).agg(F.count("*").alias("n")),
    f"SELECT {_cases('page_id % 6')} AS reason, count(*) AS n FROM pages WHERE page_id % 6 < 5 GROUP BY 1",
)
_asked = lambda s, d: V.orgs(s, d).select("name").union(V.orgs(s, d).where("length(description) > 90").select(F.concat(F.lit("Who knows: "), F.substring("description", 60, 14)))).toDF("query")
_add(
    "t7_lookup", lambda s, d: audit.lookup_institutions(V.orgs(s, d), V.events(s, d), _asked(s, d).union(V.orgs(s, d).select(F.substring("description", 30, 12)))).withColumn("event_titles", F.array_join("event_titles", "|")),
    r"""WITH a AS (SELECT name AS query FROM v_org UNION SELECT 'Who knows: ' || substr(description, 60, 14) FROM v_org WHERE length(description) > 90 UNION SELECT substr(description, 30, 12) FROM v_org ),
        b AS (SELECT query, substr(trim(regexp_replace(query, '[？?。！!，,；;：:]', ' ', 'g')), 1, 200) AS b FROM a WHERE query IS NOT NULL),
        q AS (SELECT query, lower(trim(CASE WHEN n <> '' THEN n ELSE b END)) AS q FROM (SELECT *, regexp_extract(b, '[\x{4E00}-\x{9FFF}A-Za-z0-9·&（）()-]{2,80}(大学|学院|研究院|研究所|实验室|基金会|公司|协会)') AS n FROM b)),
        h AS (SELECT query, entity_id, name FROM v_org o JOIN q ON q.q <> '' AND contains(lower(concat_ws(chr(10), o.name, o.description)), q.q)),
        e AS (SELECT query, entity_id, name, id, title, CASE WHEN event_date IS NULL OR event_date IN ('', 'unknown') THEN 1 ELSE 0 END AS u, event_date AS d, created_at AS c FROM h LEFT JOIN v_event v ON v.organization_id = h.entity_id),
        f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name NULLS FIRST, entity_id, u, d DESC NULLS LAST, c DESC NULLS LAST, id NULLS FIRST) AS r FROM e),
        k AS (SELECT *, row_number() OVER (PARTITION BY query, entity_id ORDER BY u, d DESC NULLS LAST, c DESC NULLS LAST, id NULLS FIRST) AS k FROM f WHERE r <= 12),
        t AS (SELECT query, entity_id, name, coalesce(string_agg(title, '|' ORDER BY k) FILTER (title IS NOT NULL), '') AS event_titles FROM k WHERE k <= 3 GROUP BY 1, 2, 3)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY name NULLS FIRST, entity_id) AS INTEGER) AS place, entity_id, event_titles FROM t QUALIFY place <= 3""",
)
_add("t14_due_sources", lambda s, d: topk.due_sources(health.source_state(V.fetches(s, d)).withColumn("next_check_at", F.col("next_check_at").cast("timestamp")), "2024-03-01 00:00:00", 20).select("source_id", F.date_format("next_check_at", "yyyy-MM-dd HH:mm:ss").alias("due")),
    f"""SELECT source_id, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM (SELECT source_id, CASE WHEN status = 403 THEN TIMESTAMP '9999-12-31 00:00:00' WHEN status = 404 THEN ts + INTERVAL 7 DAY
        WHEN status = 429 THEN ts + INTERVAL 2 HOUR ELSE ts + INTERVAL 1 HOUR END AS due FROM ({_state})) WHERE due <= TIMESTAMP '2024-03-01 00:00:00' ORDER BY due, source_id LIMIT 20""",
)
_add("d6_union_candidates", lambda s, d: dedup.union_candidates(V.events(s, d).where("id % 2 = 0"), V.events(s, d).where("id % 3 = 0")).select("id", "source_rank"), "SELECT id, 0 AS source_rank FROM v_event WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM v_event WHERE id % 3 = 0")
_add(
    "w3_apply_discovery", lambda s, d: writes.apply_discovery(V.named(s, d).withColumn("search_status", F.lit("pending")), V.named(s, d).where(_number() % 3 == 0).select("entity_id", F.when(_number() % 6 == 0, "https://new.org").alias("website_url"))).select("entity_id", "website_url", "search_status"),
    """SELECT entity_id, CASE WHEN k % 6 = 0 AND website_url IS NULL THEN 'https://new.org' ELSE website_url END AS website_url,
        CASE WHEN k % 6 = 0 THEN 'success' WHEN k % 3 = 0 THEN 'failed' ELSE 'pending' END AS search_status FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named )""",
)
_add("w6_reset_tracking", lambda s, d: writes.reset_tracking(_sources(s, d), V.events(s, d))[0].select("entity_id", "search_status", "event_search_status"), "SELECT entity_id, 'pending' AS search_status, 'pending' AS event_search_status FROM v_supplier")
_add("s6_log_complete", lambda s, d: writes.check_log_complete(V.pages(s, d).select((F.col("page_id") % 200 + 1).alias("position"), F.lit(260).alias("total"))),
    """SELECT 'doubled' AS problem, p AS position FROM (SELECT page_id % 200 + 1 AS p FROM pages) GROUP BY p HAVING count(*) > 1
        UNION ALL SELECT 'missing', i FROM range(1, 261) r(i) WHERE i NOT IN (SELECT page_id % 200 + 1 FROM pages)""",
)
_add(
    "s7_conform_schema", lambda s, d: writes.conform_schema(V.suppliers(s, d), _target(), {"official_domain": ["country"]}, {"kind": "institution"}),
    "SELECT CAST(entity_id AS VARCHAR) AS entity_id, name, country AS official_domain, 'institution' AS kind, CAST(NULL AS INTEGER) AS founded FROM v_supplier",
)


def _target():
    from pyspark.sql.types import StructType

    return StructType.fromDDL("entity_id string, name string, official_domain string, kind string, founded int")


_add(
    "a1_audit_tags", lambda s, d: cleaning.audit_tags(*[V.suppliers(s, d).where(F.col("entity_id") % 4 == i).select(F.col("name").alias("old_name"), F.upper("name").alias("new_name"), "name", F.lower("name").alias("attempted_correction")) for i in range(4)]),
    """SELECT unnest([name, upper(name)]) AS name, 'corrected' AS status, 'suggested_name=' || upper(name) AS detail FROM v_supplier WHERE entity_id % 4 = 0
        UNION ALL SELECT name, 'rejected_hallucination', 'attempted_correction=' || lower(name) FROM v_supplier WHERE entity_id % 4 = 1
        UNION ALL SELECT name, 'invalid_name', 'descriptive_text' FROM v_supplier WHERE entity_id % 4 = 2 UNION ALL SELECT name, 'needs_retry', 'network_error' FROM v_supplier WHERE entity_id % 4 = 3""",
)
_status = lambda s, d: V.named(s, d).withColumn("cleaning_status", F.when(_number() % 2 == 0, "corrected")).withColumn("audit_note", F.lit(None).cast("string")).withColumn("retry_count", F.lit(None).cast("int"))
_add(
    "a3_sync_audit", lambda s, d: audit.sync_audit(_status(s, d), V.named(s, d).where(_number() % 3 == 0).select("entity_id", F.when(_number() % 9 == 0, "invalid_name").otherwise("valid").alias("status"), F.lit("d").alias("detail"))).select("entity_id", "cleaning_status", "audit_note"),
    """SELECT entity_id, CASE WHEN k % 9 = 0 THEN 'invalid_name' WHEN k % 2 = 0 THEN 'corrected' WHEN k % 3 = 0 THEN 'valid' ELSE 'unreviewed' END AS cleaning_status,
        CASE WHEN k % 9 = 0 OR (k % 3 = 0 AND k % 2 <> 0) THEN 'd' END AS audit_note FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named )""",
)
_add(
    "a4_apply_retries", lambda s, d: audit.apply_retries(_status(s, d), V.named(s, d).where(_number() % 5 == 0).select("entity_id", F.when(_number() % 10 == 0, "VALID").alias("verdict"), F.lit("n").alias("note")), V.named(s, d).where(_number() % 3 == 0)).select("entity_id", "cleaning_status", "retry_count"),
    """SELECT entity_id, CASE WHEN k % 10 = 0 THEN 'valid' WHEN k % 5 = 0 THEN 'needs_retry' WHEN k % 3 = 0 THEN 'valid_confirmed' WHEN k % 2 = 0 THEN 'corrected' END AS cleaning_status,
        CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS retry_count FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named )""",
)
_add(
    "b1_digest_run", lambda s, d: cleaning.digest_run(_timed(s, d), V.orgs(s, d), V.orgs(s, d).select(F.lit("a").alias("window_start"), F.lit("b").alias("window_end"), F.lit("c").alias("content_hash"), F.lit("pushed").alias("status")), *_hours()).select("event_count", "action", "content_hash"),
    """SELECT count(*) AS event_count, 'create' AS action, sha256('06:00:00|18:00:00|' || coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY relevance_score DESC, c DESC, id), '')) AS content_hash FROM (
        SELECT id, relevance_score, substr(created_at, 12) AS c FROM v_event WHERE substr(created_at, 12) >= '06:00:00' AND substr(created_at, 12) < '18:00:00' AND relevance_score >= 6 ORDER BY relevance_score DESC, c DESC, id LIMIT 60)""",
)
_add("c5_import", lambda s, d: audit.import_organizations(V.named(s, d).select(_number().alias("pos"), "name", F.col("website_url").alias("domain")), V.orgs(s, d))[0].select("slug", "name", "website_url"))
_add("c6_name_requests", lambda s, d: audit.name_requests(V.orgs(s, d).withColumn("name", F.concat(F.lit("平台 "), "name")), V.events(s, d)))
_add("l5_validate_digest", lambda s, d: V.events(s, d).select("id", audit.validate_digest(F.to_json(F.struct(F.col("title").alias("headline"), F.array("title").alias("keyDevelopments"), F.array().cast("array<string>").alias("crossInstitutionTrends"), F.array("title").alias("implications"), F.array("title").alias("watchlist"))), F.lit(True)).alias("valid")), "SELECT id, trim(title) <> '' AS valid FROM v_event")
_add("l6_parse_score", lambda s, d: V.events(s, d).select("id", cleaning.parse_score(F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"score": '), F.col("relevance_score").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("Score - "), F.col("relevance_score").cast("string")))).alias("score")), "SELECT id, CAST(relevance_score AS DOUBLE) AS score FROM v_event")
_add("l7_parse_verdict", lambda s, d: V.events(s, d).select("id", model_io.parse_verdict(F.to_json(F.struct(F.when(F.col("id") % 3 == 0, "CORRECTED").otherwise("VALID").alias("status"), F.col("title").alias("name"))))["status"].alias("status")), "SELECT id, CASE WHEN id % 3 <> 0 THEN 'VALID' WHEN length(trim(title)) >= 2 THEN 'CORRECTED' END AS status FROM v_event")
_add(
    "l10_apply_translations", lambda s, d: cleaning.apply_translations(V.events(s, d), V.events(s, d).where("id % 2 = 0").select("id", F.lower("title").alias("t")), "id", {"translated_title": "t"}).select("id", "title", "translated_title"),
    "SELECT id, title, CASE WHEN id % 2 = 0 AND trim(title) <> '' THEN lower(title) END AS translated_title FROM v_event",
)
_add("l11_apply_profiles", lambda s, d: audit.apply_profiles(V.named(s, d).withColumn("summary", F.lit(None).cast("string")), V.named(s, d).where(_number() % 2 == 0).select("entity_id", F.col("slug").alias("text")), V.named(s, d).where(_number() % 4 == 0).select("entity_id", F.lit("told").alias("profile"))).select("entity_id", "description", "summary"),
    """SELECT entity_id, coalesce(made, description) AS description, made AS summary FROM (SELECT *, CASE WHEN k % 2 = 0 THEN '## 机构简介' || chr(10) || '- **全称**：' || name || chr(10) || '- **成立时间**：未查证' || chr(10) || '- **核心领域**：未查证'
        || chr(10) || '- **简介**：' || CASE WHEN k % 4 = 0 THEN 'told' ELSE '[原文] ' || slug END END AS made FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named ))""",
)
_evidence = lambda s, d: _hits(s, d).select("entity_id", F.element_at(F.array(*[F.lit(x) for x in ("registered", "wiki", "guess", "search")]), (F.col("pos") % 4 + 1).cast("int")).alias("tier"), "url", (F.col("pos") * 7 % 101).cast("int").alias("confidence"), F.when(F.col("pos") % 2 == 0, F.col("url")).alias("news_url"))
_add("m14_decide_site", lambda s, d: audit.decide_site(V.orgs(s, d).withColumn("entity_type", F.when(F.length("slug") % 6 == 0, "地区").otherwise("高校")), _evidence(s, d)),
    """SELECT entity_id, CASE WHEN length(slug) % 6 <> 0 THEN b.url END AS url, CASE WHEN length(slug) % 6 = 0 THEN 'not_applicable' WHEN b IS NULL THEN 'not_found' WHEN b.confidence >= 72 AND b.pos % 2 = 0 THEN 'news_verified'
        WHEN b.confidence >= 72 THEN 'official_verified' ELSE 'candidate' END AS status FROM v_org LEFT JOIN (SELECT organization_id, arg_min({'url': source_url, 'confidence': c, 'pos': id}, (c < 72, id % 4, -c, source_url)) AS b
        FROM (SELECT *, id * 7 % 101 AS c FROM v_event ) GROUP BY 1) e ON e.organization_id = entity_id""",
)
_add("m1_identity_terms", lambda s, d: match.identity_terms(V.orgs(s, d).withColumn("aliases", F.array(F.concat(F.lit("The "), "name")))).select("entity_id", F.array_join("terms", "|").alias("terms"), F.array_join("core_terms", "|").alias("core_terms")))
_add("m12_supported_corrections", lambda s, d: audit.supported_corrections(V.orgs(s, d).select("entity_id", "name", "slug", F.substring("name", 1, 5).alias("corrected"), F.lit("").alias("context"))).select("entity_id", "corrected"))
_add("k7_changed_pages", lambda s, d: health.cycle_stats(health.changed_pages(V.pages(s, d).select(F.col("page_id").alias("source_id"), F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.col("html").alias("body")), V.pages(s, d).where("page_id % 2 = 0").select(F.col("page_id").alias("source_id"), F.sha2("html", 256).alias("content_hash")))), "SELECT count(*) AS checked, count(*) FILTER (page_id % 7 <> 0 AND page_id % 2 <> 0) AS changed, count(*) FILTER (page_id % 7 = 0) AS failed FROM v_page")
_rules = [("0{7}[0-9]$", 5, 1), ("[13579]$", 0, 3), ("^Supplier", None, 2), ("[24]{2}", 6, None)]
_add(
    "q27_catalog_violations",
    lambda s, d: audit.catalog_violations(V.suppliers(s, d).select("name", F.when(F.col("entity_id") % 9 == 0, "odd").otherwise("lab").alias("entity_type"), "country", "region", F.when(F.col("entity_id") % 7 == 0, "needs_review").otherwise("sure").alias("location_confidence")), s.createDataFrame(_rules, "pattern string, min_chars int, min_words int"), ["lab"], ["none"]),
    r"""SELECT name, 'type' AS violation FROM v_supplier WHERE entity_id % 9 = 0 UNION ALL SELECT name, 'location' FROM v_supplier WHERE entity_id % 7 = 0
        UNION ALL SELECT name, 'pattern ' || p FROM v_supplier, (VALUES ('0{7}[0-9]$', 5, 1), ('[13579]$', 0, 3), ('^Supplier', 0, 2), ('[24]{2}', 6, 0)) r(p, c, w)
        WHERE regexp_matches(name, p) AND length(regexp_replace(name, '\s+', '', 'g')) >= c AND len(regexp_extract_all(name, '[A-Za-z0-9]+')) >= w""",
)
_function("x11_news_links", lambda: F.size(extract.news_links(F.col("html"))), "CAST(least(len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=\"([^\"]+)\"[^>]*>(.*?)</a>', 0), lambda x: x), lambda x: regexp_matches(x, '(?i)news|event|announcement|press')))), 20) AS INTEGER)")
_add("x12_parse_serp", lambda s, d: extract.parse_serp(_html(s, d).select("page_id", F.regexp_replace("html", '<li><a href="', "<a class='result__a' href=\"https://x.org").alias("html")), "page_id", "anchors"))
_add("x9_feed_article_count", lambda s, d: audit.feed_article_count(_html(s, d).select("url", F.col("host").alias("site"), F.lit("rss").alias("source_type"), F.regexp_replace("html", "<p>", "<item>").alias("text")), _html(s, d).select(F.col("host").alias("site"))), "SELECT url, CAST(least(len(regexp_extract_all(html, '<p>')), 20) AS BIGINT) AS n FROM v_page")
# Titles of suppliers: each leads to the next one of its ten, the last to the page itself; every seventh ten is a circle.
_links = lambda s, d: V.suppliers(s, d).select(F.col("name").alias("from"), F.when(F.col("entity_id") % 10 < 9, F.concat(F.lit("Supplier_#"), F.lpad((F.col("entity_id") + 1).cast("string"), 9, "0"))).when(F.floor(F.col("entity_id") / 10) % 7 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("entity_id") - 9).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Page "), F.floor(F.col("entity_id") / 10).cast("string"))).alias("to"))
_add(
    "j16_chain_ends", lambda s, d: joins.chain_ends(_links(s, d).withColumn("to", F.replace("to", F.lit("_"), F.lit("")))),
    """SELECT * FROM (WITH RECURSIVE l AS (SELECT name AS a, CASE WHEN entity_id % 10 < 9 THEN 'Supplier#' || lpad((entity_id + 1)::VARCHAR, 9, '0') WHEN (entity_id // 10) % 7 = 0 THEN 'Supplier#' || lpad((entity_id - 9)::VARCHAR, 9, '0') ELSE 'Page ' || (entity_id // 10) END AS b FROM v_supplier ),
        r(a, b, steps) AS (SELECT a, b, 1 FROM l UNION ALL SELECT r.a, l.b, steps + 1 FROM r JOIN l ON l.a = r.b WHERE steps < 50)
        SELECT a AS "from", b AS "to" FROM r WHERE b NOT IN (SELECT a FROM l))""",
)
_add(
    "j16_match_wiki", lambda s, d: match.match_wiki(
        V.suppliers(s, d).select("entity_id", "name", F.lit("").alias("website_url"), F.array(F.lit("lab"), F.lit("x")).alias("context"), F.when(F.col("entity_id") % 4 == 0, "人物").otherwise("高校").alias("entity_type")),
        V.suppliers(s, d).where("entity_id % 10 = 0").select(F.concat(F.lit("Page_"), F.floor(F.col("entity_id") / 10).cast("string")).alias("title"), F.concat(F.lit("{{Infobox\n| website = {{URL|https://www.s"), F.col("entity_id").cast("string"), F.lit(".org/}}\n}} a "), F.when(F.col("entity_id") % 20 == 0, "lab").otherwise("firm")).alias("wikitext")),
        _links(s, d).withColumn("to", F.replace("to", F.lit("r_#"), F.lit("r#"))),
    ).select("entity_id", "url", "pre_score"),
    """SELECT entity_id, 'https://www.s' || p || '.org/' AS url, CAST(CASE WHEN p % 20 = 0 THEN 60 ELSE 55 END AS INTEGER) AS pre_score FROM (SELECT entity_id, (entity_id // 10) * 10 AS p, (entity_id // 10) AS t FROM v_supplier )
        WHERE t % 7 <> 0 AND EXISTS (SELECT 1 FROM v_supplier z WHERE z.entity_id = t * 10 + 9) AND EXISTS (SELECT 1 FROM v_supplier z WHERE z.entity_id = p) AND (entity_id % 4 <> 0 OR p % 20 = 0)""",
)
_add(
    "m13_profile_page", lambda s, d: match.select_profile_page(V.events(s, d).select(F.col("organization_id").alias("entity_id"), (F.col("id") % 3).cast("int").alias("tier"), F.col("id").cast("int").alias("rank"), F.col("source_url").alias("url"), F.col("summary").alias("text")), V.orgs(s, d)),
)
_add(
    "g12_audit_report", lambda s, d: cleaning.audit_report(_status(s, d).withColumn("audit_note", F.concat(F.lit("suggested_name="), F.upper("name"))).withColumn("cleaning_status", F.when(_number() % 3 == 0, "valid").when(_number() % 3 == 1, "corrected").otherwise("api_timeout")), V.named(s, d)),
    """SELECT DISTINCT CASE k % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'corrected' ELSE 'failed' END AS list, name, CASE WHEN k % 3 = 1 THEN upper(name) END AS detail FROM (SELECT *, CAST(substr(entity_id, 5) AS BIGINT) AS k FROM v_named )""",
)
_add(
    "k5_cooldowns", lambda s, d: health.cooldowns(V.fetches(s, d).select(F.col("source_id").alias("provider"), "ts", "status", F.col("error_code").alias("message"))),
    """SELECT * FROM (WITH RECURSIVE f AS (SELECT source_id AS provider, ts, status, error_code AS message, status IN (403, 429) AS bad, row_number() OVER (PARTITION BY source_id ORDER BY ts, status NULLS FIRST, error_code NULLS FIRST) AS r FROM v_fetch),
        w(provider, opened) AS (SELECT provider, min(ts) FROM f WHERE bad GROUP BY 1
            UNION SELECT w.provider, min(f.ts) FROM w JOIN f ON f.provider = w.provider AND f.bad AND f.ts >= w.opened + INTERVAL 30 MINUTE GROUP BY w.provider, w.opened),
        o AS (SELECT w.provider, w.opened, min(f.r) AS r FROM w JOIN f ON f.provider = w.provider AND f.ts = w.opened AND f.bad GROUP BY 1, 2)
        SELECT f.provider, f.ts, status, message, count(o.r) = 0 AS admitted FROM f LEFT JOIN o ON o.provider = f.provider AND f.r > o.r AND f.ts < o.opened + INTERVAL 30 MINUTE GROUP BY f.provider, f.ts, status, message, f.r)""",
)
_cut = "regexp_replace('1. 公司名称: ' || text, '[\\x{0000}-\\x{001F}\\x{007F}\\x{00A0}\\x{3000} ]+', ' ', 'g')"
for _pattern in T.NAME_CUTS:
    _cut = f"regexp_replace({_cut}, '{_pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
_doc_function("f7_clean_name", lambda: T.clean_name(F.concat(F.lit("1. 公司名称: "), _t())), f"trim(regexp_replace({_cut}, '\\s+', ' ', 'g'))")

# Names, evidence and scores in SQL, for the queries above and some more. -------------------------------------------


def _sql(name: str, sql: str) -> None:
    SQL[name] = V.with_views(sql)


_listed = lambda words: ", ".join(f"'{w}'" for w in words)
_norm = lambda c: f"trim(regexp_replace(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9\\x{{3400}}-\\x{{9FFF}}]+', ' ', 'g'))"
_canon = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[(（\\[【][^)）\\]】]*[)）\\]】]', ' ', 'g'), '[\\s,-]*(19|20)[0-9][0-9]\\s*$', '', 'g'), '\\s+', ' ', 'g'))"
_once = lambda x: f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"
_generic = _listed(match.GENERIC_TERMS)
_spaced = lambda text, t: f"contains(' ' || {text} || ' ', ' ' || {t} || ' ')"
_compact = "regexp_replace(coalesce({h}, ''), '[^a-z0-9]', '', 'g')"
_ident = f"""SELECT entity_id, name, slug, description, norm_name, tokens, list_filter(list_transform(tokens, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 4) AS domain_tokens
    FROM (SELECT *, {_once('w')} AS tokens FROM (SELECT *, list_filter(string_split(norm_name, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_generic}) AND NOT regexp_matches(w, '^[0-9]+$')) AS w
        FROM (SELECT *, {_norm(_canon('name'))} AS norm_name FROM v_org )))"""
_add(
    "m4_entity_identity",
    lambda s, d: match.context_tokens(match.entity_identity(V.orgs(s, d)), summary="description").select("entity_id", "norm_name", *[F.array_join(c, "|").alias(c) for c in ("tokens", "domain_tokens", "context")]),
    f"""SELECT entity_id, norm_name, array_to_string(tokens, '|') AS tokens, array_to_string(domain_tokens, '|') AS domain_tokens, coalesce(array_to_string({_once('c')}[1:8], '|'), '') AS context
        FROM (SELECT *, list_filter(string_split({_norm("coalesce(description, '')")}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({_generic}) AND NOT regexp_matches(w, '{match.RECORD_WORDS}')
            AND NOT coalesce(list_contains(string_split({_norm('name')}, ' '), w), false)) AS c FROM ({_ident}))""",
)
_facts = f"""SELECT *, coalesce(regexp_matches(norm_name, '[\\x{{4E00}}-\\x{{9FFF}}]'), false) AS han, len(list_filter(tokens, lambda t: {_spaced('said', 't')})) AS hit,
    CAST(len(list_filter(domain_tokens, lambda t: contains({_compact.format(h='h')}, t))) AS INTEGER) AS host_matches,
    CAST(len(list_filter(['the', 'de'], lambda t: {_spaced('said', 't')})) AS INTEGER) AS context_matches, coalesce(regexp_matches(h, '\\.(gov|edu)(\\.[a-z]{{2}})?$'), false) AS public
    FROM (SELECT e.id AS pos, o.*, length(slug) % 2 = 0 AS badge, e.title, e.source_url, {_sh} AS h, concat_ws(' ', e.title, e.summary) AS raw, {_norm("concat_ws(' ', e.title, e.summary)")} AS said
        FROM v_event e JOIN ({_ident}) o ON o.entity_id = e.organization_id)"""
_core = "CASE WHEN han AND length(norm_name) >= 2 AND contains(said, norm_name) THEN {w} ELSE 0 END"
_sharing = "CASE WHEN len(tokens) > 0 THEN CAST(floor({w} * hit / len(tokens) + 0.5) AS BIGINT) ELSE 0 END"
_points = f"""SELECT *, CASE WHEN h IS NULL THEN 0 ELSE least(70, CASE WHEN badge THEN 20 ELSE 0 END + {_core.format(w=38)} + {_sharing.format(w=28)} + CASE WHEN host_matches > 0 THEN 22 ELSE 0 END
        + CASE WHEN public THEN 8 ELSE 0 END + CASE WHEN regexp_matches(raw, '(?i)official|官网|官方网站') THEN 8 ELSE 0 END) END AS pre_score,
    least(50, {_core.format(w=35)} + {_sharing.format(w=30)} + CASE WHEN host_matches > 0 THEN 18 ELSE 0 END + CASE WHEN public THEN 12 ELSE 0 END + least(context_matches * 8, 16)) AS identity_score FROM ({_facts})"""
_sql("m5_score_candidates", f"SELECT entity_id, pos, CAST(pre_score AS BIGINT) AS pre_score FROM ({_points})")
_sql("m6_score_identity", f"SELECT entity_id, pos, CAST(identity_score AS BIGINT) AS identity_score, host_matches, context_matches FROM ({_points})")
_sql(
    "m7_accept_candidates",
    f"""SELECT entity_id, pos, CAST(least(100, pre_score + identity_score) AS BIGINT) AS confidence FROM ({_points}) WHERE identity_score >= 20 AND pre_score + identity_score >= 45
        AND NOT (NOT han AND len(tokens) <= 1 AND ((length(norm_name) <= 10 AND host_matches = 0) OR (length(norm_name) <= 8 AND context_matches = 0)))""",
)
_sql(
    "t10_best_candidate",
    f"""SELECT entity_id, url, pre_score, confidence, CASE WHEN confidence >= 72 THEN 'official_verified' ELSE 'candidate' END AS status FROM (
        SELECT entity_id, source_url AS url, CAST(pre_score AS BIGINT) AS pre_score, CAST(least(100, pre_score + identity_score) AS BIGINT) AS confidence, row_number() OVER (PARTITION BY entity_id ORDER BY pre_score DESC, pos) AS k
        FROM ({_points}) WHERE pre_score >= 20 QUALIFY k <= 4) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, k) = 1""",
)
_sql(
    "m10_domain_candidates",
    f"""SELECT entity_id, CAST(i - 1 AS INTEGER) AS pos, g[i] AS domain FROM (SELECT entity_id, CASE WHEN len(tokens) = 1 THEN [tokens[1] || '.com', tokens[1] || '.org']
        ELSE [array_to_string(tokens, '') || '.com', array_to_string(tokens, '-') || '.com', array_to_string(tokens, '') || '.org'] END AS g FROM ({_ident}) WHERE len(tokens) > 0), range(1, 4) r(i) WHERE i <= len(g)""",
)
_rejected = f"coalesce({_under('host', U.PLATFORM_ROOTS)} OR regexp_matches(lower({V.sql_part('url', 5)}), '\\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv|jpg|png)$'), true)"
_sql(
    "d7_stored_candidates",
    f"""SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY badge DESC, pos, url) AS rank, url, CAST(score AS BIGINT) AS score FROM (SELECT entity_id, url, bool_or(badge) AS badge, min(pos) AS pos, max(least(greatest(pre_score * 2, 0), 100)) AS score
        FROM (SELECT *, {V.sql_host('url')} AS host FROM (SELECT *, regexp_replace({_su}, '^http:', 'https:') AS url FROM ({_points}))) WHERE url IS NOT NULL AND NOT {_rejected} GROUP BY 1, 2) QUALIFY rank <= 5""",
)

_aliased = lambda s, d: match.identity_terms(V.orgs(s, d).withColumn("aliases", F.array(F.concat(F.lit("The "), "name"))))
_terms = f"""SELECT entity_id, terms, {_once('every')} AS core_terms FROM (SELECT *, terms || list_filter(flatten(list_transform(terms, lambda t: string_split(t, ' '))), lambda w: length(w) >= 3 AND w NOT IN ({_generic})) AS every
    FROM (SELECT entity_id, list_filter([{_norm('name')}, {_norm("'The ' || name")}], lambda t: length(t) >= 2) AS terms FROM v_org ))"""
_sql("m1_identity_terms", f"SELECT entity_id, array_to_string(terms, '|') AS terms, array_to_string(core_terms, '|') AS core_terms FROM ({_terms})")
_named_here = lambda s, d: V.events(s, d).withColumn("said", F.concat_ws(" ", "title", "summary", F.when(F.col("id") % 2 == 0, F.col("source_url")))).join(_aliased(s, d).withColumnRenamed("entity_id", "organization_id").select("organization_id", "terms"), "organization_id")
_saying = f"""SELECT *, {_norm("concat_ws(' ', title, summary, CASE WHEN id % 2 = 0 THEN source_url END)")} AS said, {_sh} AS h FROM v_event JOIN ({_terms}) t ON t.entity_id = organization_id"""
_evident = "len(list_filter(terms, lambda t: contains(said, t) OR contains(replace(said, ' ', ''), replace(t, ' ', '')))) > 0"
_add("m2_has_evidence", lambda s, d: _named_here(s, d).select("id", match.has_evidence(F.col("said"), F.col("terms")).alias("value")), f"SELECT id, {_evident} AS value FROM ({_saying})")
_keyed = f"len(list_filter(list_transform(flatten(list_transform(terms, lambda t: [replace(t, ' ', '')] || string_split(t, ' '))), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 3 AND contains({_compact.format(h='h')}, w))) > 0"
_add(
    "q17_is_strict_candidate", lambda s, d: _named_here(s, d).select("id", match.is_strict_candidate(F.col("source_url"), F.col("said")).alias("value")),
    f"SELECT id, lower({V.sql_part('source_url', 1)}) IN ('http', 'https') AND {_keyed} AND {_evident} AS value FROM ({_saying})",
)
_titled = lambda: F.concat("title", F.when(F.col("id") % 3 == 0, " University").when(F.col("id") % 3 == 1, "研究院").otherwise(""))
_english = f"[A-Z][A-Za-z0-9&''.-]*(\\s+[A-Z][A-Za-z0-9&''.-]*){{0,8}}\\s+({'|'.join(extract.ENGLISH_SUFFIXES)})"
_chinese = f"[\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9& .-]{{2,60}}({'|'.join(extract.CHINESE_SUFFIXES)})"
_plausible = lambda c: f"(length({c}) BETWEEN 2 AND 100 AND regexp_matches({c}, '^({_english}|{_chinese})$') AND NOT regexp_matches({c}, '^([0-9]|一个|一些|多个|许多|各类|不同|相关|主要|部分|所有|该|本|这|其)') AND {c} NOT IN ({_listed(extract.CHINESE_SUFFIXES)}))"
_add(
    "q22_is_plausible_name", lambda s, d: V.events(s, d).select("id", extract.is_plausible_name(_titled()).alias("value")),
    f"SELECT id, {_plausible('n')} AS value FROM (SELECT id, title || CASE id % 3 WHEN 0 THEN ' University' WHEN 1 THEN '研究院' ELSE '' END AS n FROM v_event )",
)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A table for each nation, its header above a row for each of its customers."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, F.concat(F.initcap("c_mktsegment"), F.lit(" University"))).when(k % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("see the "), F.initcap("c_mktsegment"), F.lit(" Institute")))
    body = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("table_id"), (k + 1).alias("row_no"), F.posexplode(F.array(said, said)).alias("col_no", "text"))
    head = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("table_id"), F.lit(0).cast("bigint").alias("row_no"), F.posexplode(F.array(F.lit("合作机构名称"), F.lit("备注"))).alias("col_no", "text"))
    return head.union(body)


_add(
    "x13_names_from_tables", lambda s, d: extract.names_from_tables(_cells(s, d)),
    """SELECT c_nationkey AS table_id, c_custkey + 1 AS row_no, 0 AS col_no, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || CASE c_custkey % 3 WHEN 0 THEN ' University' ELSE ' Institute' END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 1""",
)
_paragraphs = "list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')"
_fitting = "list_filter(range(1, least(len(p), 301) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + i - 1 <= 600)"
_body = f"SELECT doc_id, lang, source, CASE WHEN p IS NULL THEN NULL WHEN len(p) = 0 THEN '' WHEN length(p[1]) > 600 THEN substr(p[1], 1, 600) ELSE array_to_string(p[1:len({_fitting})], chr(10)) END AS body FROM (SELECT *, {_paragraphs} AS p FROM documents)"
_sql("x14_context_body", f"SELECT doc_id, body FROM ({_body})")
_add(
    "x14_context_block", lambda s, d: cleaning.context_block(_docs(s, d).select("doc_id", F.col("lang").alias("title"), F.lit(None).cast("string").alias("published"), F.col("source").alias("domain"), F.col("text").alias("body")), 600).select("doc_id", "context_block"),
    f"SELECT doc_id, CASE WHEN length(body) >= 160 THEN 'title: ' || coalesce(lang, '') || chr(10) || 'published_at: unknown' || chr(10) || 'source_domain: ' || coalesce(source, '') || chr(10) || 'body:' || chr(10) || body END AS context_block FROM ({_body})",
)
_stop = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '[\\x{{4E00}}-\\x{{9FFF}}]')) >= 20 THEN len(regexp_extract_all({c}, '[{T.CHINESE_STOPWORDS}]')) / len(regexp_extract_all({c}, '[\\x{{4E00}}-\\x{{9FFF}}]')) WHEN len(regexp_extract_all(regexp_replace(lower({c}), '\\s+', '', 'g'), '[a-z]+')) >= 10 THEN len(list_filter(regexp_extract_all(regexp_replace(lower({c}), '\\s+', '', 'g'), '[a-z]+'), lambda w: w IN ({_listed(T.ENGLISH_STOPWORDS)}))) / len(regexp_extract_all(regexp_replace(lower({c}), '\\s+', '', 'g'), '[a-z]+')) END"
_sql("f11_stopword_ratio", f"SELECT doc_id, round({_stop('text')}, 9) AS value FROM documents")


def _broken(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    words = [f"CASE WHEN regexp_matches({t}, '{p}'){'' if name == 'login' else f' AND length({t}) <= 2000'} THEN '{name}' END" for name, p in P.SUMMARY_KEYWORDS]
    return f"CASE WHEN {t} = '' THEN '' ELSE array_to_string(list_filter([{', '.join(words)}, CASE WHEN length({t}) < 20 THEN 'short' END, CASE WHEN {_stop(t)} >= 0.45 THEN 'stopwords' END], lambda x: x IS NOT NULL), ',') END"


_sql(
    "c3_plan_deep_clean",
    f"""SELECT entity_id, n AS event_count, CASE WHEN k % 5 = 0 THEN 'platform,path' ELSE '' END AS website_rules, r AS summary_rules, CASE WHEN k % 5 = 0 AND n = 0 THEN 'delete' WHEN k % 5 = 0 THEN 'clear_site' ELSE 'clear_text' END AS action
        FROM (SELECT entity_id, k, {_broken('description')} AS r, (SELECT count(*) FROM v_named_event e WHERE e.organization_id = entity_id) AS n FROM (SELECT entity_id, CAST(substr(entity_id, 5) AS BIGINT) AS k,
        description || CASE WHEN CAST(substr(entity_id, 5) AS BIGINT) % 7 = 0 THEN ' cookie 登录 and more of it' ELSE ' and other things' END AS description FROM v_named )) WHERE k % 5 = 0 OR r <> ''""",
)
_sql("q24_summary_rules", f"SELECT doc_id, {_broken('text')} AS value FROM documents")
_when = lambda: F.when(F.col("id") % 2 == 0, F.col("event_date")).otherwise(F.col("created_at"))
_function("f25_display_date", lambda: D.display_date(_when()), "CASE WHEN id % 2 = 0 AND event_date = 'unknown' THEN '近期' WHEN id % 2 = 0 THEN event_date || ' 00:00' ELSE substr(created_at, 1, 16) END", V.events, "id", "v_event")
_add(
    "f32_content_hash",
    lambda s, d: V.events(s, d).groupBy("organization_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("organization_id", cleaning.content_hash(F.lit("2024-01-01"), F.lit("2024-01-02"), F.transform("ids", lambda x: x.cast("string"))).alias("value")),
    "SELECT organization_id, sha256('2024-01-01|2024-01-02|' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS value FROM v_event GROUP BY 1",
)


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    """An answer for each event: by its id whole, or with one item that breaks a rule."""
    kind = F.col("id") % 6
    told = [F.col("title"), F.col("summary"), F.col("source_url").alias("url")]
    item = lambda *more: F.to_json(F.struct(*told, *more))
    good = item(F.lit(7).alias("relevance_score"))
    shapes = [
        good, item(F.lit(0).alias("relevance_score")), item(F.lit(11).alias("relevanceScore")), item(F.lit(7).alias("relevance_score"), F.lit("x").alias("odd")),
        item(F.lit(7).alias("relevance_score"), F.lit(7).alias("relevanceScore")), F.concat(good, F.lit(","), item(F.lit(5.5).alias("relevance_score"))),
    ]
    made = F.element_at(F.array(*shapes), (kind + 1).cast("int"))
    return V.events(spark, d).where("title <> '' and summary <> ''").select(F.col("id").alias("organization_id"), F.concat(F.lit("["), made, F.lit("]")).alias("response"))


_add("l3_validate_items", lambda s, d: model_io.parse_event_responses(_shaped(s, d)).select("organization_id", "title", "relevance_score"), "SELECT id AS organization_id, title, 7 AS relevance_score FROM v_event WHERE title <> '' AND summary <> '' AND id % 6 = 0")
_add(
    "c6_apply_name_verdicts",
    lambda s, d: cleaning.apply_name_verdicts(V.named(s, d), V.named(s, d).select("entity_id", F.when(_number() % 2 == 0, F.col("name")).otherwise("gone").alias("old_name"), F.when(_number() % 3 == 0, "CORRECTED").otherwise("VALID").alias("status"), F.upper("name").alias("name"))).select("entity_id", "name"),
    "SELECT entity_id, CASE WHEN CAST(substr(entity_id, 5) AS BIGINT) % 6 = 0 THEN upper(name) ELSE name END AS name FROM v_named",
)
_domain = f"CASE WHEN regexp_matches(host, '^({U.LABEL}\\.)+[a-z]{{2,63}}$') AND length(host) <= 253 AND NOT {_under('host', U.PLATFORM_ROOTS)} THEN host END"
_sql(
    "m9_decide_official",
    f"""SELECT entity_id, b.domain AS domain, coalesce(b.status, 'not_found') AS status FROM v_org LEFT JOIN (SELECT id, min({{'tier': tier, 'pos': pos, 'domain': domain, 'status': status}}) AS b FROM (
        SELECT entity_id AS id, 1 AS tier, 0 AS pos, slug AS domain, 'whitelist' AS status FROM v_org WHERE length(slug) % 5 = 0 UNION ALL SELECT entity_id, 3, 0, slug, 'cached' FROM v_org WHERE length(slug) % 7 = 0
        UNION ALL SELECT organization_id, CASE WHEN id % 2 = 0 THEN 2 ELSE 4 END, id, {_domain}, CASE WHEN id % 2 = 0 THEN 'verified' ELSE 'unverified' END FROM (SELECT *, {_sh} AS host FROM v_event )) WHERE domain IS NOT NULL GROUP BY 1) ON id = entity_id""",
)
_poor = f"coalesce({_under('host', U.LOW_QUALITY_DOMAINS)} OR list_has_any({_hl}, ['blog', 'blogs', 'forum', 'forums', 'bbs']), true)"
_sql(
    "m13_profile_page",
    f"""SELECT entity_id, CAST(tier AS INTEGER) AS tier, source_url AS url FROM (SELECT e.*, {_sh} AS host, o.entity_id, o.name, e.id % 3 AS tier FROM v_event e JOIN v_org o ON o.entity_id = e.organization_id)
        WHERE length(trim(coalesce(summary, ''))) >= 20 AND (tier = 0 OR (contains(replace({_norm('summary')}, ' ', ''), replace({_norm('name')}, ' ', '')) AND NOT {_poor})) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY tier, id, source_url) = 1""",
)

_sql("f14_strip_tags", f"SELECT page_id, {_tagless('html')} AS value FROM pages")
_found = f"SELECT page_id, url, unnest(range(len(regexp_extract_all(html, {_anchor})))) AS pos, unnest(regexp_extract_all(html, {_anchor}, 1)) AS href, unnest(regexp_extract_all(html, {_anchor}, 2)) AS t FROM v_page"
_sql("f21_resolve_url", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {_origin} || href AS link FROM ({_found})")
_sql(
    "x12_parse_serp",
    f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, 'https://x.org' || href AS url, title, '' AS snippet, false AS badge FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM (SELECT page_id, href, min(pos) AS pos, arg_min(title, pos) AS title
        FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, {_tagless('t')} AS title FROM (SELECT page_id, unnest(range(len(regexp_extract_all(html, '(?is)<li><a href="')))) AS pos,
        unnest(regexp_extract_all(html, '(?is)<li><a href="([^"<>]+)"[^<>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<li><a href="([^"<>]+)"[^<>]*>(.*?)</a>', 2)) AS t FROM v_page)) WHERE title <> '' GROUP BY 1, 2)) WHERE n <= 8""",
)
_sql(
    "c1_plan_content_cleanup",
    f"""SELECT 'organization' AS kind, entity_id AS id, 'website_url' AS field, website_url AS before, CAST(NULL AS VARCHAR) AS after FROM (SELECT *, {_wh} AS host FROM v_org ) WHERE website_url IS NOT NULL AND {_official} IS NULL
        UNION ALL SELECT 'event', CAST(id AS VARCHAR), 'title', title, CASE WHEN trim(title) = '' THEN '未命名事件' ELSE trim(title) END FROM v_event WHERE title <> trim(title) OR trim(title) = ''""",
)
_sql(
    "c5_import",
    """WITH r AS (SELECT CAST(substr(entity_id, 5) AS BIGINT) AS pos, trim(name) AS name, website_url FROM v_named WHERE trim(coalesce(name, '')) <> ''),
        l AS (SELECT name, min(pos) AS pos, arg_max(website_url, pos) FILTER (website_url IS NOT NULL) AS site FROM r GROUP BY 1),
        s AS (SELECT *, CASE WHEN s <> '' THEN s ELSE 'source-' || substr(sha256(name), 1, 16) END AS own FROM (SELECT *, substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72) AS s FROM l)),
        k AS (SELECT s.*, o.slug AS known, row_number() OVER (PARTITION BY own ORDER BY o.slug IS NULL, s.pos) AS n FROM s LEFT JOIN (SELECT name, min(slug) AS slug FROM v_org GROUP BY 1) o ON o.name = s.name)
        SELECT coalesce(known, CASE WHEN n > 1 OR own IN (SELECT slug FROM v_org ) THEN own || '-' || substr(sha256(name), 1, 8) ELSE own END) AS slug, name, rtrim(site, '/') AS website_url FROM k""",
)
