"""Audit results back into the organizations, imports, lookups, site decisions, payload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normalize as N
from ..functions import urls as U
from ..operators import predicates as P
from ..operators.extract import sitemap_locations
from ..operators.patterns import find_patterns
from ..storage import written
from .cleaning import resolve_tags

#: Fixed values.
SYNC_PRIORITY = {"corrected": 5, "rejected_hallucination": 4, "invalid_name": 3, "needs_retry": 2, "valid": 1}
BLOCKED_BRANDS = ["apple", "microsoft", "yahoo", "google", "amazon", "meta", "facebook", "stack overflow", "百度", "百度经验"]
RETRY_STATUS = {"VALID": "valid", "INVALID": "invalid_name", "CORRECTED": "corrected"}
NO_SITE_TYPES = ["地区", "技术方向"]
DIGEST_KEYS = ["headline", "keyDevelopments", "crossInstitutionTrends", "implications", "watchlist"]


def sync_audit(orgs: DataFrame, matched: DataFrame) -> DataFrame:
    """Organizations with the winning status of their tags (entity_id, status, detail); ``valid`` takes the place of no other
    status."""
    won = resolve_tags(matched, SYNC_PRIORITY).select("entity_id", F.col("cleaning_status").alias("_s"), F.col("audit_note").alias("_n"))
    old = F.coalesce("cleaning_status", F.lit("unreviewed"))
    take = F.col("_s").isNotNull() & ((F.col("_s") != "valid") | old.isin("unreviewed", "valid"))
    joined = orgs.join(won, "entity_id", "left")
    return joined.withColumn("audit_note", F.when(take, F.col("_n")).otherwise(F.col("audit_note"))).withColumn("cleaning_status", F.when(take, F.col("_s")).otherwise(old)).drop("_s", "_n")


def apply_retries(orgs: DataFrame, results: DataFrame, valid: DataFrame) -> DataFrame:
    """Outcomes of retried name checks (entity_id, verdict, note; a verdict that could not be had is null) counted and set;
    organizations in ``valid`` that were not retried are confirmed."""
    status = F.create_map(*[F.lit(x) for k, v in RETRY_STATUS.items() for x in (k, v)])
    done = results.dropDuplicates(["entity_id"]).select("entity_id", F.coalesce(F.try_element_at(status, F.col("verdict")), F.lit("needs_retry")).alias("_s"), F.col("note").alias("_n"), F.lit(1).alias("_k"))
    sure = valid.select("entity_id").distinct().join(results.select("entity_id"), "entity_id", "left_anti")
    sure = sure.select("entity_id", F.lit("valid_confirmed").alias("_s"), F.lit("confirmed by valid names").alias("_n"), F.lit(0).alias("_k"))
    joined = orgs.join(done.union(sure), "entity_id", "left")
    made = joined.withColumn("cleaning_status", F.coalesce("_s", "cleaning_status")).withColumn("audit_note", F.coalesce("_n", "audit_note"))
    return made.withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + F.coalesce("_k", F.lit(0))).drop("_s", "_n", "_k")


def supported_corrections(df: DataFrame) -> DataFrame:
    """Corrections (name, slug, corrected, context) that hold up: no well-known brand, two characters or more and a quarter of
    the shorter name in common with the name or its slug, and the correction stands in the context."""
    new, old, key = N.compact(F.col("corrected")), N.compact(F.col("name")), N.compact(F.col("slug"))
    kept = df.where(~F.lower(F.trim("corrected")).isin(BLOCKED_BRANDS) & (F.length(new) >= 2) & (F.length(old) >= 2))
    kept = kept.where(F.contains(F.lower(F.concat_ws(" ", "name", "slug", "context")), F.lower("corrected")))
    common = F.greatest(N.lcs_len(new, old), N.lcs_len(new, key))
    return kept.withColumn("_common", common).withColumn("_short", F.least(F.length(new), F.length(old))).where("_common >= 2 and _common >= 0.25 * _short").drop("_common", "_short")


def import_organizations(records: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert by slug, skipped rows with reason) of records (pos, name, domain): slugs of known names are kept, two
    names that share a slug get the later one's digest added."""
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    skipped = records.where(blank).select("pos", F.lit("missing name").alias("reason"))
    named = records.where(~blank).withColumn("name", F.trim("name"))
    last = named.groupBy("name").agg(F.max_by("domain", F.when(U.official_domain(F.col("domain")).isNotNull(), F.col("pos"))).alias("domain"), F.min("pos").alias("pos"))
    known = orgs.groupBy("name").agg(F.min("slug").alias("_slug"))
    taken = orgs.select(F.col("slug").alias("_own")).distinct()
    rows = last.join(known, "name", "left").withColumn("_own", N.slug(F.col("name")))
    first = F.row_number().over(Window.partitionBy("_own").orderBy(F.col("_slug").isNull(), "pos"))
    rows = rows.withColumn("_first", first).join(taken.withColumn("_taken", F.lit(True)), "_own", "left")
    clash = F.col("_slug").isNull() & ((F.col("_first") > 1) | F.coalesce("_taken", F.lit(False)))
    slug = F.coalesce("_slug", F.when(clash, F.concat("_own", F.lit("-"), F.substring(F.sha2("name", 256), 1, 8))).otherwise(F.col("_own")))
    site = F.concat(F.lit("https://"), U.official_domain(F.col("domain")))
    return rows.select(F.concat(F.lit("org-"), slug).alias("entity_id"), slug.alias("slug"), "name", site.alias("website_url"), "pos"), skipped


def lookup_institutions(orgs: DataFrame, events: DataFrame, queries: DataFrame, limit: int = 3, per_org: int = 3, complete: bool = False) -> DataFrame:
    """(query, place, entity_id, event_titles) of questions (query): organizations whose name or description holds the
    institution asked for, at most ``limit``, each with at most ``per_org`` of its newest events. Of the joined rows only the
    first ``4 * limit`` count, unless ``complete``.

    All questions are looked for in one pass over the organizations' texts, and only true hits become rows. What cannot be among
    the first rows of a question goes before the join: later organizations, and older events than an organization can give.
    """
    from ..operators.topk import first_per_group, newest

    wanted = written(queries.select("query", F.lower(P.institution_query(F.col("query"))).alias("_q")).where("_q <> ''").distinct())
    text = F.lower(F.concat_ws("\n", *[F.col(c) for c in ("name", "original_name", "description", "summary") if c in orgs.columns]))
    hit = find_patterns(orgs.select("entity_id", "name", text.alias("_t")), "_t", wanted, "_q").join(wanted, "_q").select("query", "entity_id", "name")
    if not complete:
        hit = first_per_group(hit, ["query"], [F.col("name"), F.col("entity_id")], 4 * limit, "_h").drop("_h")  # each gives a row at least
    told = events.select(F.col("organization_id").alias("entity_id"), "id", "title", "event_date", "created_at")
    told = first_per_group(told, ["entity_id"], newest(), per_org if complete else max(per_org, 4 * limit), "_h").drop("_h")
    rows = hit.join(told, "entity_id", "left")
    if not complete:
        order = [F.col("name"), F.col("entity_id"), *newest()]
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("_r") <= 4 * limit)
    told = rows.withColumn("_e", F.row_number().over(Window.partitionBy("query", "entity_id").orderBy(*newest()))).where(F.col("_e") <= per_org)
    titles = F.transform(F.sort_array(F.collect_list(F.struct("_e", "title"))), lambda x: x["title"])
    found = told.groupBy("query", "entity_id", "name").agg(F.filter(titles, lambda t: t.isNotNull()).alias("event_titles"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("name", "entity_id"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "entity_id", "event_titles")


def decide_site(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, url, status) of each entity by its evidence (entity_id, tier, url, confidence, news_url): tiers in order
    registered, wiki, guess, search; a confidence of 72 makes a site official, a news page of it verified; below that it is a
    candidate. Regions and technologies have no site."""
    tiers = F.array(*[F.lit(x) for x in ("registered", "wiki", "guess", "search")])
    sure = F.col("confidence") >= 72
    ranked = evidence.withColumn("_o", F.struct((~sure).alias("a"), F.array_position(tiers, F.col("tier")).alias("b"), (-F.col("confidence")).alias("c"), F.col("url").alias("d")))
    best = ranked.groupBy("entity_id").agg(F.min_by(F.struct("url", "confidence", "news_url"), "_o").alias("e"))
    status = (
        F.when(F.col("entity_type").isin(NO_SITE_TYPES), "not_applicable").when(F.col("e").isNull(), "not_found")
        .when((F.col("e.confidence") >= 72) & F.col("e.news_url").isNotNull(), "news_verified").when(F.col("e.confidence") >= 72, "official_verified").otherwise("candidate")
    )
    made = entities.select("entity_id", "entity_type").join(best, "entity_id", "left").withColumn("status", status)
    return made.select("entity_id", F.when(~F.col("status").isin("not_applicable", "not_found"), F.col("e.url")).alias("url"), "status")


def catalog_violations(df: DataFrame, rules: DataFrame, types: list[str], blocked: list[str], most_rules: int = 1000) -> DataFrame:
    """(name, violation) of a catalog's rows: types that are not allowed, blocked names, names that match a pattern of ``rules``
    (pattern, min_chars, min_words), no country or region, an unsettled location. The rules are a configuration of at most
    ``most_rules``; they become one expression, so that the catalog is read once and joined with nothing."""
    n = F.col("name")
    plain = [
        F.when(~F.coalesce(F.col("entity_type").isin(types), F.lit(False)), "type"), F.when(N.norm_letters(n).isin([b.lower() for b in blocked]), "blocked"),
        F.when(F.coalesce("country", F.lit("")) == "", "country"), F.when(F.coalesce("region", F.lit("")) == "", "region"), F.when(F.col("location_confidence") == "needs_review", "location"),
    ]
    chars, words = F.length(F.regexp_replace(n, r"\s+", "")), F.regexp_count(n, F.lit("[A-Za-z0-9]+"))
    read = rules.select("pattern", "min_chars", "min_words").limit(most_rules + 1).collect()
    if len(read) > most_rules:
        raise ValueError(f"more than {most_rules} rules; they are meant to be a configuration")
    hits = [F.when(n.rlike(r["pattern"]) & (chars >= (r["min_chars"] or 0)) & (words >= (r["min_words"] or 0)), F.lit(f"pattern {r['pattern']}")) for r in read if r["pattern"] is not None]
    return df.select("name", F.explode(F.array_compact(F.array(*plain, *hits))).alias("violation"))


def validate_digest(c: Column, has_events: Column) -> Column:
    """Whether a text is a digest: exactly its keys, a headline, lists of texts, and developments that are texts or objects with
    a title or summary; with events there has to be a development."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")
    keys = F.json_object_keys(body)
    headline = F.trim(F.coalesce(F.get_json_object(body, "$.headline"), F.lit("")))
    items = F.from_json(F.get_json_object(body, "$.keyDevelopments"), "array<string>")
    fields = F.array(*[F.lit(x) for x in ("title", "organization", "summary", "significance", "url")])

    def good(x: Column) -> Column:
        told = F.trim(F.concat(F.coalesce(F.get_json_object(x, "$.title"), F.lit("")), F.coalesce(F.get_json_object(x, "$.summary"), F.lit(""))))
        same = F.array_sort(F.json_object_keys(x)) == F.array_sort(fields)
        return F.when(F.trim(x).startswith("{"), F.coalesce(same, F.lit(False)) & (told != "")).otherwise(F.trim(x) != "")

    lists = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>").isNotNull() for k in DIGEST_KEYS[2:]]
    whole = (F.array_sort(keys) == F.array_sort(F.array(*[F.lit(k) for k in DIGEST_KEYS]))) & (headline != "") & items.isNotNull() & F.forall(items, good)
    for one in lists:
        whole = whole & one
    return F.coalesce(whole & ((F.size(items) > 0) | ~has_events), F.lit(False))


def normalize_profile(c: Column, name: Column) -> Column:
    """A profile text in the fixed template; one that has its heading stays."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^```(markdown)?\s*", ""), r"\s*```$", ""))
    filled = F.concat(F.lit("## 机构简介\n- **全称**："), name, F.lit("\n- **成立时间**：未查证\n- **核心领域**：未查证\n- **简介**："), F.when(bare != "", bare).otherwise("未查证"))
    return F.when(bare.rlike(r"##\s*机构简介"), bare).otherwise(filled)


def apply_profiles(orgs: DataFrame, pages: DataFrame, answers: DataFrame, prefix: str = "[原文] ") -> DataFrame:
    """Description and summary set from a model's answers (entity_id, profile); where an answer is missing the page's text
    (entity_id, text) is kept with a prefix; organizations without a page stay."""
    told = pages.select("entity_id", "text").join(answers.select("entity_id", "profile"), "entity_id", "left")
    new = told.join(orgs.select("entity_id", "name"), "entity_id").select("entity_id", normalize_profile(F.coalesce("profile", F.concat(F.lit(prefix), F.col("text"))), F.col("name")).alias("_new"))
    joined = orgs.join(new, "entity_id", "left")
    return joined.withColumn("description", F.coalesce("_new", "description")).withColumn("summary", F.coalesce("_new", "summary")).drop("_new")


def name_requests(orgs: DataFrame, events: DataFrame, suspects_only: bool = True) -> DataFrame:
    """Requests for a name check: names that no rule settles, with the texts and newest events of the organization."""
    from ..operators.topk import event_context

    rows = orgs.where(~F.coalesce(P.is_definitely_valid(F.col("name")), F.lit(False)))
    rows = rows.where(P.is_suspicious_name(F.col("name"))) if suspects_only else rows
    context = event_context(events).select(F.col("organization_id").alias("entity_id"), "context")
    fields = F.struct(F.col("name").alias("current_name"), "slug", "description", F.transform("context", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("events"))
    return rows.join(context, "entity_id", "left").select("entity_id", F.to_json(fields).alias("request"))


def feed_article_count(feeds: DataFrame, homepages: DataFrame, most: int = 20) -> DataFrame:
    """(url, n) of feeds (url, site, source_type, text): items of RSS, Atom and JSON; for a sitemap its addresses of news on the
    site, or those of its child sitemaps among the feeds, one level deep."""
    body, kind = F.col("text"), F.col("source_type")
    listed = F.coalesce(F.from_json(F.when(body.rlike(r"^\s*\["), body), "array<string>"), F.from_json(F.get_json_object(F.when(body.rlike(r"^\s*\{"), body), "$.items"), "array<string>"))
    objects = F.size(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.startswith("{")))
    flat = feeds.where(kind != "sitemap").select("url", F.when(kind.isin("rss", "atom"), F.regexp_count(body, F.lit(r"(?i)<(item|entry)\b"))).when(kind.isin("json", "api"), objects).otherwise(0).alias("n"))
    maps = feeds.where(kind == "sitemap").join(homepages.select("site"), "site", "left_semi")
    locs = maps.select("url", "site", body.rlike(r"(?i)<sitemapindex\b").alias("_index"), F.explode(sitemap_locations(body)).alias("_l"))
    locs = locs.withColumn("_l", U.canonical_url(F.replace("_l", F.lit("&amp;"), F.lit("&")))).where(F.col("_l").startswith("https://") & (U.site_key(U.host(F.col("_l"))) == U.site_key(F.col("site"))))
    news = F.regexp_extract("_l", U.URL, 5).rlike("(?i)news|blog|press|media|update|insight|stories|journal|announcement|新闻|动态|资讯|媒体|公告")
    own = locs.where(~F.col("_index") & news).groupBy("url").agg(F.countDistinct("_l").alias("n"))
    child = locs.where("_index").select("url", F.col("_l").alias("_child")).distinct().join(own.withColumnsRenamed({"url": "_child"}), "_child").groupBy("url").agg(F.max("n").alias("n"))
    counts = own.unionByName(child).groupBy("url").agg(F.max("n").alias("n"))
    sums = maps.select("url").join(counts, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))
    return flat.unionByName(sums).select("url", F.least("n", F.lit(most)).alias("n"))

