"""Matching entities to sites: evidence, scores, decisions. Tokens come prepared as arrays (see ``entity_identity``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from .joins import chain_ends

#: Fixed values.
GENERIC_TERMS = ["university", "institute", "institution", "college", "school", "academy", "center", "centre", "official", "the"]
MARKER = "(?i)university|institute|college|school|academy|官方|大学|学院|研究所|研究院"


def normalized(c: Column) -> Column:
    """Lower case, letters a-z, digits and Han only, single spaces; marks on letters are dropped where Spark can."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, rf"[^a-z0-9{T.WIDE_HAN}]+", " "))


def entity_identity(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``norm_name``, ``tokens`` (words of three letters or more that are not generic) and ``domain_tokens`` (four or more)."""
    words = F.filter(F.split(F.col("norm_name"), " "), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_TERMS) & ~w.rlike("^[0-9]+$"))
    df = df.withColumn("norm_name", normalized(T.canonical_name(F.col(name)))).withColumn("tokens", F.array_distinct(words))
    return df.withColumn("domain_tokens", F.filter(F.transform("tokens", lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) >= 4))


#: Words of records, not of the entity. Fixed values.
RECORD_WORDS = "实体|收录|报告|案例|^未标注$|^[ptrc][0-9]+$"


def context_tokens(df: DataFrame, name: str = "name", summary: str = "summary", k: int = 8) -> DataFrame:
    """Adds ``context``: the first ``k`` words of the summary, once each, of three letters or more, that are neither in the name
    nor generic nor words of records; empty without a summary."""
    own = F.coalesce(F.split(normalized(F.col(name)), " "), F.array().cast("array<string>"))
    words = F.split(normalized(F.coalesce(F.col(summary), F.lit(""))), " ")
    good = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_TERMS) & ~w.rlike(RECORD_WORDS))
    return df.withColumn("context", F.slice(F.array_except(good, own), 1, k))


def _contains_token(text: Column, token: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), token, F.lit(" ")))


def _share(text: Column, weight: int) -> Column:
    hit = F.size(F.filter("tokens", lambda t: _contains_token(text, t)))
    return F.when(F.size("tokens") > 0, F.floor(weight * hit / F.size("tokens") + 0.5)).otherwise(0)


def _host_hits(url: Column) -> Column:
    compact = F.regexp_replace(F.coalesce(U.host(url), F.lit("")), "[^a-z0-9]", "")
    return F.size(F.filter("domain_tokens", lambda t: F.contains(compact, t)))


def _public(url: Column) -> Column:
    return U.host(url).rlike(r"\.(gov|edu)(\.[a-z]{2})?$")


def score_candidates(df: DataFrame) -> DataFrame:
    """Adds ``pre_score`` (at most 70) of search hits: badge 20, Han core name 38, share of tokens 28, host 22, public site 8,
    the word official 8; 0 without a URL."""
    said = F.concat_ws(" ", "title", "snippet")
    text = normalized(said)
    core = F.when(T.has_han(F.col("norm_name")) & (F.length("norm_name") >= 2) & F.contains(text, F.col("norm_name")), 38).otherwise(0)
    total = (
        F.when(F.col("badge"), 20).otherwise(0) + core + _share(text, 28) + F.when(_host_hits(F.col("url")) > 0, 22).otherwise(0)
        + F.when(_public(F.col("url")), 8).otherwise(0) + F.when(said.rlike("(?i)official|官网|官方网站"), 8).otherwise(0)
    )
    return df.withColumn("pre_score", F.when(U.host(F.col("url")).isNull(), 0).otherwise(F.least(total, F.lit(70))))


def score_identity(df: DataFrame) -> DataFrame:
    """Adds ``identity_score`` (at most 50), ``host_matches`` and ``context_matches`` of fetched pages (columns page_url,
    page_text, context: array of tokens)."""
    text = normalized(F.col("page_text"))
    core = F.when(T.has_han(F.col("norm_name")) & (F.length("norm_name") >= 2) & F.contains(text, F.col("norm_name")), 35).otherwise(0)
    context = F.size(F.filter("context", lambda t: _contains_token(text, t)))
    df = df.withColumn("host_matches", _host_hits(F.col("page_url"))).withColumn("context_matches", context)
    total = core + _share(text, 30) + F.when(F.col("host_matches") > 0, 18).otherwise(0) + F.when(_public(F.col("page_url")), 12).otherwise(0) + F.least(F.col("context_matches") * 8, F.lit(16))
    return df.withColumn("identity_score", F.least(total, F.lit(50)))


def accept_candidates(df: DataFrame, least_identity: int = 20, least: int = 45) -> DataFrame:
    """Candidates whose page holds up, with ``confidence``. A short name that is one word needs a match of the host; a person
    or such a name needs one of the context."""
    confidence = F.least(F.lit(100), F.col("pre_score") + F.col("identity_score"))
    short = ~T.has_han(F.col("norm_name")) & (F.size("tokens") <= 1)
    needs_host = short & (F.length("norm_name") <= 10) & (F.col("host_matches") == 0)
    needs_context = short & (F.length("norm_name") <= 8) & (F.col("context_matches") == 0)
    trusted = F.coalesce(F.col("registered"), F.lit(False))
    good = (F.col("identity_score") >= least_identity) & (confidence >= least) & (trusted | ~(needs_host | needs_context))
    return df.withColumn("confidence", confidence).where(good)


def apply_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first reviewed candidate of each entity that a review calls official with 85 or more, without conflicts, and that
    has 50 of its own; its confidence is the rounded mean, within 72 and 100."""
    good = reviews.where("is_official and score >= 85 and not has_conflicts").groupBy("entity_id", "url").agg(F.max("score").alias("_s"))
    joined = candidates.where("confidence >= 50").join(good, ["entity_id", "url"])
    mean = F.least(F.lit(100), F.greatest(F.lit(72), F.floor((F.col("confidence") + F.col("_s")) / 2 + 0.5)))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("pos", "url"))
    return joined.withColumn("confidence", mean).withColumn("_p", place).where("_p = 1").drop("_p", "_s")


def domain_candidates(df: DataFrame, most: int = 3) -> DataFrame:
    """Guesses of an entity's domain from its name: joined and hyphenated, com and org."""
    joined, dashed = F.array_join("tokens", ""), F.array_join("tokens", "-")
    guesses = F.array_distinct(F.array(*[F.concat(x, F.lit(s)) for s in (".com", ".org") for x in (joined, dashed)]))
    return df.where(F.size("tokens") > 0).select("entity_id", F.posexplode(F.slice(guesses, 1, most)).alias("pos", "domain"))


def search_queries(df: DataFrame) -> DataFrame:
    """The queries to search an organization's news with: by script of its name, and by site where it has one."""
    n = F.col("name")
    words = F.when(T.has_han(n), F.array(F.concat(n, F.lit(" 新闻")), F.concat(n, F.lit(" 动态")))).otherwise(F.array(F.concat(n, F.lit(" news")), F.concat(n, F.lit(" announcement"))))
    site = F.when(U.host(F.col("website_url")).isNotNull(), F.array(F.concat(F.lit("site:"), U.host(F.col("website_url"))))).otherwise(F.array().cast("array<string>"))
    return df.select("entity_id", F.posexplode(F.concat(words, site)).alias("pos", "query"))


#: What a query adds for a kind of organization. Fixed values.
ROUTE_TERMS = {
    "accelerator": "news incubator accelerator", "enterprise": "news press release", "university": "research news technology transfer", "research": "research news press release",
    "public": "official news policy announcement", "generic": "news press release",
}


def official_site_query(df: DataFrame) -> DataFrame:
    """(entity_id, query) to find an entity's official site with, out of ``name, entity_type, route_kind, city, region`` and
    ``context`` (an array): its canonical name, up to three words of context, one place that is known, and what is looked for,
    by the kind of entity. A name with a Latin word is asked for without its Chinese part."""
    name = T.entity_title(F.col("name"))
    latin = name.rlike("[A-Za-z]{2,}")
    asked = F.when(latin, F.regexp_replace(name, rf"[{T.WIDE_HAN}（）]", " ")).otherwise(name)
    kinds = F.create_map(*[F.lit(x) for kv in ROUTE_TERMS.items() for x in kv])
    route = F.coalesce(F.try_element_at(kinds, F.col("route_kind")), F.lit(ROUTE_TERMS["generic"]))
    wanted = F.when(~latin & F.col("name").rlike(f"[{T.WIDE_HAN}]"), "官网").when(F.col("entity_type") == "人物", "official profile").otherwise(F.concat(F.lit("official website "), route))
    places = F.filter(F.array("city", "region"), lambda p: F.coalesce(p, F.lit("")).rlike(".") & ~p.rlike("未标注|T[0-9]+"))
    words = F.slice(F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda t: ~latin | t.rlike("(?i)[a-z]")), 1, 3)
    query = F.concat_ws(" ", asked, F.array_join(words, " "), F.try_element_at(places, F.lit(1)), wanted)
    return df.select("entity_id", T.collapse_ws(query).alias("query"))


def identity_terms(df: DataFrame) -> DataFrame:
    """Adds ``terms`` (name and aliases, normalized, of two characters or more) and ``core_terms`` (with their words that are not
    generic)."""
    every = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalized)
    df = df.withColumn("terms", F.array_distinct(F.filter(every, lambda t: F.length(t) >= 2)))
    words = F.filter(F.flatten(F.transform("terms", lambda t: F.split(t, " "))), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_TERMS))
    return df.withColumn("core_terms", F.array_union("terms", words))


def has_evidence(text: Column, terms: Column) -> Column:
    """Whether a text names a term, with or without its spaces."""
    n = normalized(text)
    compact = F.replace(n, F.lit(" "), F.lit(""))
    return F.exists(terms, lambda t: F.contains(n, t) | F.contains(compact, F.replace(t, F.lit(" "), F.lit(""))))


def is_strict_candidate(url: Column, text: Column) -> Column:
    """An http(s) URL whose host contains a word of the name (``terms``), and a text that names it."""
    compact = F.regexp_replace(F.coalesce(U.host(url), F.lit("")), "[^a-z0-9]", "")
    words = F.flatten(F.transform("terms", lambda t: F.concat(F.array(F.replace(t, F.lit(" "), F.lit(""))), F.split(t, " "))))
    keyed = F.exists(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) >= 3), lambda w: F.contains(compact, w))
    return F.lower(F.regexp_extract(url, U.URL, 1)).isin("http", "https") & keyed & has_evidence(text, F.col("terms"))


def verify_homepages(fetches: DataFrame, orgs: DataFrame, loose: bool = False) -> DataFrame:
    """(entity_id, url, accepted, reason) of fetched homepages. ``fetches``: entity_id, url, status, content_type, html."""
    from ..operators.predicates import is_spam_page

    rows = fetches.join(identity_terms(orgs).select("entity_id", "terms", "core_terms"), "entity_id")
    text, h = T.visible_text(F.col("html")), F.coalesce(U.host(F.col("url")), F.lit(""))
    head = F.concat_ws(" ", T.page_title(F.col("html")), F.regexp_extract(T.up_to_last(F.col("html"), ">"), r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1))
    compact = F.regexp_replace(h, "[^a-z0-9]", "")
    on_host = F.exists(F.flatten(F.transform("terms", lambda t: F.split(t, " "))), lambda w: (F.length(w) >= 3) & F.contains(compact, F.regexp_replace(w, "[^a-z0-9]", "")))
    reason = (
        F.when(h == "", "invalid_url").when(~F.col("status").between(200, 299), "http_status")
        .when((F.col("content_type") != "") & ~F.col("content_type").rlike(r"(?i)text/html|application/xhtml\+xml"), "content_type").when(is_spam_page(h, text), "spam")
        .when(has_evidence(text, F.col("terms")) | has_evidence(F.col("html"), F.col("terms")), "evidence")
        .when(F.lit(loose) & has_evidence(head, F.col("core_terms")), "core_evidence").when(on_host & text.rlike(MARKER), "host_and_marker").otherwise("no_evidence")
    )
    return rows.select("entity_id", "url", reason.isin("evidence", "core_evidence", "host_and_marker").alias("accepted"), reason.alias("reason"))


def decide_official(orgs: DataFrame, whitelist: DataFrame, hits: DataFrame, cached: DataFrame, most: int = 8) -> DataFrame:
    """(entity_id, domain, status, candidates): the whitelist's domain, else the first verified hit, else a cached one, else the first hit as
    unverified. ``whitelist`` and ``cached``: entity_id, domain; ``hits``: entity_id, pos, url, accepted.
    ``candidates`` are the first ``most`` URLs of the hits, once each; none where the whitelist decides."""
    seen = hits.where("url is not null").groupBy("entity_id", "url").agg(F.min("pos").alias("pos"))
    seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy("pos", "url"))).where(F.col("_n") <= most)
    listed = seen.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda x: x["url"]).alias("_c"))
    good = hits.withColumn("domain", U.official_domain(F.col("url"))).where("domain is not null")
    tiers = [(whitelist.select("entity_id", "domain", F.lit(0).alias("pos")), 1, "whitelist"), (good.where("accepted").select("entity_id", "domain", "pos"), 2, "verified")]
    tiers += [(cached.select("entity_id", "domain", F.lit(0).alias("pos")), 3, "cached"), (good.where("not accepted").select("entity_id", "domain", "pos"), 4, "unverified")]
    every = None
    for df, tier, status in tiers:
        df = df.where("domain is not null").select("entity_id", F.struct(F.lit(tier).alias("tier"), "pos", "domain", F.lit(status).alias("status")).alias("e"))
        every = df if every is None else every.union(df)
    best = every.groupBy("entity_id").agg(F.min("e").alias("e"))
    none = F.array().cast("array<string>")
    kept = F.when(F.col("e.status") == "whitelist", none).otherwise(F.coalesce("_c", none))
    told = orgs.select("entity_id").join(best, "entity_id", "left").join(listed, "entity_id", "left")
    return told.select("entity_id", F.col("e.domain").alias("domain"), F.coalesce("e.status", F.lit("not_found")).alias("status"), kept.alias("candidates"))


def match_wiki(entities: DataFrame, pages: DataFrame, redirects: DataFrame, context_chars: int = 80_000) -> DataFrame:
    """Encyclopedia pages of entities (with ``context``, tokens) by title after redirects (followed to the end of their chain;
    what leads into a circle is no redirect): (entity_id, title, url, pre_score) with the website of the page's infobox. Context
    is looked for in the first ``context_chars`` characters of a page. A person or a short one-word name needs a word of its context on the page."""
    from .predicates import is_rejected_url

    key = lambda c: T.collapse_ws(F.lower(F.replace(c, F.lit("_"), F.lit(" "))))
    field = F.regexp_extract("wikitext", r"(?im)^\|\s*(?:website|homepage|official_website|url|官网|官方网站|网站|網址)\s*=\s*(.+)$", 1)
    raw = F.regexp_replace(F.regexp_extract(field, r"(?i)https?://[^\s}\]|<>]+", 0), r"[),.;]+$", "")
    bare = F.regexp_extract(field, r"(?i)(^|[|{\s])(www\.[a-z0-9.-]+(?:/[^\s}\]|<>]*)?)", 2)
    url = U.canonical_url(F.when(raw != "", raw).when(bare != "", F.concat(F.lit("https://"), bare)), force_https=True)
    sites = pages.select(key(F.col("title")).alias("_k"), "title", "wikitext", url.alias("url")).where("url is not null").where(~is_rejected_url(F.col("url")))
    sites = sites.groupBy("_k").agg(F.min(F.struct("title", "wikitext", "url")).alias("p")).select("_k", "p.*")
    moved = chain_ends(redirects.select(key(F.col("from")).alias("_from"), key(F.col("to")).alias("_to")), "_from", "_to")
    named = entity_identity(entities).withColumn("_from", key(T.entity_title(F.col("name")))).where("length(_from) between 1 and 100")
    joined = named.join(moved, "_from", "left").withColumn("_k", F.coalesce("_to", "_from")).join(sites, "_k")
    text = normalized(F.concat_ws(" ", "title", F.substring("wikitext", 1, context_chars)))
    joined = joined.withColumn("_c", F.size(F.filter("context", lambda t: _contains_token(text, t))))
    unsure = (F.col("entity_type") == "人物") | (~T.has_han(F.col("norm_name")) & (F.size("tokens") <= 1) & (F.length("norm_name") <= 8))
    return joined.where(~unsure | (F.col("_c") > 0)).select("entity_id", "title", "url", F.least(F.lit(70), 55 + 5 * F.col("_c")).alias("pre_score"))


def select_profile_page(pages: DataFrame, orgs: DataFrame, least: int = 20) -> DataFrame:
    """The page for each entity's profile out of fetched ones (entity_id, tier 0 official 1 candidate 2 searched, rank, url, text):
    the first by tier and rank with enough text; beyond the official site it has to name the organization, and a candidate may
    not be of low quality."""
    from .predicates import is_low_quality_url

    rows = pages.join(orgs.select("entity_id", "name"), "entity_id").where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least)
    named = F.contains(F.replace(normalized(F.col("text")), F.lit(" "), F.lit("")), F.replace(normalized(F.col("name")), F.lit(" "), F.lit("")))
    good = (F.col("tier") == 0) | (named & ~is_low_quality_url(F.col("url")))
    best = rows.where(good).groupBy("entity_id").agg(F.min(F.struct("tier", "rank", "url")).alias("b"))
    return best.select("entity_id", "b.tier", "b.url")
