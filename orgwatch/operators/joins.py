"""Joins of organizations with events, lists and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..storage import written


def events_with_org(events: DataFrame, orgs: DataFrame, how: str = "left") -> DataFrame:
    named = orgs.select(F.col("entity_id").alias("organization_id"), F.col("name").alias("organization_name"), F.col("slug").alias("organization_slug"))
    return events.join(named, "organization_id", how)


def orgs_without_events(orgs: DataFrame, events: DataFrame) -> DataFrame:
    return orgs.join(events.select(F.col("organization_id").alias("entity_id")), "entity_id", "left_anti")


def duplicate_name_rows(orgs: DataFrame) -> DataFrame:
    doubled = orgs.where("name is not null").groupBy("name").count().where("count > 1")
    return orgs.join(doubled.select("name"), "name", "left_semi")


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def fresh_events(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found events whose (organization, canonical URL) is not stored."""
    known = stored.select("organization_id", U.canonical_url(F.col("source_url")).alias("_url"))
    return found.withColumn("_url", U.canonical_url(F.col("source_url"))).join(known, ["organization_id", "_url"], "left_anti").drop("_url")


def match_whitelist(orgs: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The first whitelist entry (by ``pos``) whose name, code or alias is an organization's name; entries on platforms
    do not count. ``whitelist``: pos, name, code, aliases, domain."""
    keys = F.explode(F.array_distinct(F.filter(F.concat(F.array("name", "code"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())))
    good = whitelist.withColumn("domain", U.official_domain(F.col("domain"))).where("domain is not null")
    listed = good.select("pos", "domain", keys.alias("_k")).select("pos", "domain", T.norm_name(F.col("_k")).alias("_k"))
    first = listed.groupBy("_k").agg(F.min_by("domain", "pos").alias("whitelist_domain"))
    return orgs.withColumn("_k", T.norm_name(F.col("name"))).join(first, "_k", "left").drop("_k")


def match_cached(orgs: DataFrame, previous: DataFrame) -> DataFrame:
    """The first earlier result (by ``pos``) found under an organization's original name or id, with a safe domain."""
    safe = previous.withColumn("domain", U.official_domain(F.col("domain"))).where("domain is not null")
    entry = F.struct("pos", "domain")
    names = safe.groupBy(T.norm_name(F.col("name")).alias("_n")).agg(F.min(entry).alias("_by_name"))
    ids = safe.where("entity_id is not null").groupBy("entity_id").agg(F.min(entry).alias("_by_id"))
    both = orgs.withColumn("_n", T.norm_name(F.coalesce("original_name", "name"))).join(names, "_n", "left").join(ids, "entity_id", "left")
    return both.withColumn("cached_domain", F.least("_by_name", "_by_id")["domain"]).drop("_n", "_by_name", "_by_id")


def join_llm_items(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answered items that refer to a candidate of their organization."""
    known = candidates.select("organization_id", U.canonical_url(F.col("url")).alias("_url"), F.col("pos")).groupBy("organization_id", "_url").agg(F.min("pos").alias("candidate_pos"))
    return items.withColumn("_url", U.canonical_url(F.col("url"))).join(known, ["organization_id", "_url"]).drop("_url")


def match_audit_names(orgs: DataFrame, names: DataFrame, loose: bool = True) -> DataFrame:
    """(name, entity_id, tier): audit names matched to organizations' names and original names, exactly, else normalized,
    else loosely; a loose match counts only if it leads to one organization."""
    known = orgs.select("entity_id", F.explode(F.array_distinct(F.array_compact(F.array("name", "original_name")))).alias("_name"))
    wanted = names.select("name").distinct()
    exact = wanted.join(known.withColumnRenamed("_name", "name"), "name").select("name", "entity_id", F.lit("exact").alias("tier"))
    left = wanted.join(exact.select("name"), "name", "left_anti")
    found, found_all = exact, exact
    for tier, key in (("normalized", T.norm_name), ("loose", T.loose_name))[: 2 if loose else 1]:
        a = left.withColumn("_k", key(F.col("name"))).where("_k <> ''")
        b = known.select("entity_id", key(F.col("_name")).alias("_k")).where("_k <> ''").distinct()
        found = a.join(b, "_k").select("name", "entity_id", F.lit(tier).alias("tier"))
        if tier == "loose":
            single = found.groupBy("name").agg(F.count("*").alias("_n"), F.min("entity_id").alias("entity_id")).where("_n = 1")
            found = single.select("name", "entity_id", F.lit(tier).alias("tier"))
        found_all = found_all.unionByName(found)
        left = left.join(found.select("name"), "name", "left_anti")
    return found_all


def name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("entity_id", F.col("name").alias("old_name"))
    return old.join(after.select("entity_id", F.col("name").alias("new_name")), "entity_id").where("not (old_name <=> new_name)")


def organization_profile(orgs: DataFrame, events: DataFrame, sources: DataFrame, k: int = 100) -> DataFrame:
    """Each organization with its newest events and its sources by name."""
    from .topk import latest_per_org

    newest = latest_per_org(events, k).groupBy(F.col("organization_id").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "title"))).alias("events"))
    named = sources.groupBy(F.col("organization_slug").alias("slug")).agg(F.sort_array(F.collect_list(F.struct("name", "url"))).alias("sources"))
    return orgs.select("entity_id", "slug", "name").join(newest, "entity_id", "left").join(named, "slug", "left")


def merge_organizations(target: DataFrame, sources: list[DataFrame], fill: tuple[str, ...] = ("description", "summary")) -> DataFrame:
    """Snapshots merged in order: ids that the target lacks come from the first source that has them; of known ids only
    empty ``fill`` columns are filled, by the first source with a text."""
    ranked = target.withColumn("_rank", F.lit(0))
    for i, s in enumerate(sources, 1):
        ranked = ranked.unionByName(s.withColumn("_rank", F.lit(i)), allowMissingColumns=True)
    # By snapshot; of several rows of an id within one, the one with the least hash, so that reruns agree.
    ranked = ranked.withColumn("_rank", F.struct("_rank", F.xxhash64(*target.columns)))
    text = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("_rank"))
    rest = [c for c in target.columns if c not in ("entity_id", *fill)]
    agg = [F.min_by(F.struct(*rest), "_rank").alias("_rest")] if rest else []
    agg += [F.coalesce(F.min_by(c, text(c)), F.min_by(c, "_rank")).alias(c) for c in fill]
    merged = ranked.groupBy("entity_id").agg(*agg)
    return merged.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in target.columns])


def merge_events(target: DataFrame, sources: list[DataFrame], orgs: DataFrame, per_org: bool = False) -> DataFrame:
    """Events that sources add to the target: a known URL, or without a URL a known id, or a missing organization, keeps an
    event out; of several with one URL or id the first source's smallest id stays. Returns target and additions."""
    new = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        new = s if new is None else new.unionByName(s, allowMissingColumns=True)
    url = U.canonical_url(F.col("source_url"))
    scope = ["organization_id"] if per_org else []
    new = new.withColumn("_url", url).join(orgs.select(F.col("entity_id").alias("organization_id")), "organization_id", "left_semi")
    known = target.select(*scope, url.alias("_url")).where("_url is not null")
    with_url = new.where("_url is not null").join(known, [*scope, "_url"], "left_anti")
    once = F.row_number().over(Window.partitionBy(*scope, "_url").orderBy("_rank", "id"))
    with_url = with_url.withColumn("_once", once).where("_once = 1").drop("_once")
    added = with_url.unionByName(new.where("_url is null")).join(target.select("id"), "id", "left_anti")
    first = F.row_number().over(Window.partitionBy("id").orderBy("_rank", F.col("_url").asc_nulls_last()))
    added = added.withColumn("_once", first).where("_once = 1").select(*target.columns)
    return target.unionByName(added)


def chain_ends(links: DataFrame, frm: str = "from", to: str = "to") -> DataFrame:
    """(frm, to) with each link followed to the end of its chain. Of several links from one place the least counts. What
    leads into a circle has no end and is left out; null ends are no links.

    Each round doubles the way that every pointer has gone, so a chain of n links takes log2(n) joins over the links alone;
    a pointer that still moves after more steps than there are links goes round in a circle.
    """
    once = links.where(F.col(frm).isNotNull() & F.col(to).isNotNull()).groupBy(F.col(frm).alias("_a")).agg(F.min(to).alias("_b"))
    once = written(once)
    total, steps = once.count(), 1
    while True:
        further = once.select(F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        moved = written(once.join(further, "_b", "left").select("_a", "_b", "_c"))
        if steps > total or moved.where("_c is not null").isEmpty():
            return moved.where("_c is null").select(F.col("_a").alias(frm), F.col("_b").alias(to))
        once, steps = moved.select("_a", F.coalesce("_c", "_b").alias("_b")), 2 * steps
