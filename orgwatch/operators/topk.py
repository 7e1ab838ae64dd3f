"""First rows by an order, as a whole or for each group. Every order ends in a key, so that runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U


def newest(unknown_last: bool = True) -> list[Column]:
    """Events by date, newest first; events without a date last (or, as plain text order has it, ``unknown`` first)."""
    known = F.when(F.col("event_date").isNull() | F.col("event_date").isin("", "unknown"), 1).otherwise(0)
    return [*([known] if unknown_last else []), F.desc_nulls_last("event_date"), F.desc_nulls_last("created_at"), F.col("id")]


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; groups are cut before they are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50, most: int = 100) -> DataFrame:
    number, limit = max(1, number), min(most, max(1, limit))
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def recent_events(events: DataFrame, orgs: DataFrame, n: int = 500, unknown_last: bool = True) -> DataFrame:
    """The newest events with their organization's columns."""
    named = orgs.select(F.col("entity_id").alias("organization_id"), F.col("name").alias("organization_name"), F.col("slug").alias("organization_slug"), "website_url")
    return events.join(named, "organization_id").orderBy(*newest(unknown_last)).limit(n)


def top_per_category(recent: DataFrame, k: int = 10) -> DataFrame:
    return first_per_group(recent.withColumn("category", T.category(F.col("event_type"))), ["category"], newest(), k)


def watch_lists(recent: DataFrame, k: int = 10) -> DataFrame:
    """The first events from organizations' own sites (``active``) and from others (``passive``)."""
    active = U.is_official(F.col("source_url"), F.col("website_url"))
    listed = recent.where(F.coalesce("source_url", F.lit("")) != "").withColumn("watch", F.when(active, "active").otherwise("passive"))
    return first_per_group(listed, ["watch"], newest(), k)


def latest_per_org(events: DataFrame, k: int = 100) -> DataFrame:
    return first_per_group(events, ["organization_id"], newest(), k)


def event_context(events: DataFrame, k: int = 10) -> DataFrame:
    """For each organization its newest events as an array of (rank, title, url)."""
    top = latest_per_org(events, k)
    return top.groupBy("organization_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", F.col("source_url").alias("url")))).alias("context"))


def duplicates_to_drop(orgs: DataFrame) -> DataFrame:
    """Of organizations with one name all but the first: with a description before without, then by id."""
    bare = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("name").orderBy(bare, "entity_id"))
    return orgs.where(F.col("name").isNotNull()).withColumn("_place", place).where("_place > 1").drop("_place")


def digest_events(events: DataFrame, n: int = 60) -> DataFrame:
    return events.orderBy(F.desc("relevance_score"), F.desc("created_at"), "id").limit(n)


def rank_urls(df: DataFrame, url: str = "url", preferred: list[str] | None = None) -> DataFrame:
    """Distinct URLs of each organization by source priority: official, preferred, government or university, organization, rest."""
    h = U.host(F.col(url))
    priority = (
        F.when(U.is_official(F.col(url), F.col("website_url")), 0)
        .when(U.is_under(h, preferred) if preferred else F.lit(False), 1)
        .when(h.rlike(r"(^|\.)(gov|edu|ac)(\.[a-z]{2})?$"), 2)
        .when(h.rlike(r"\.org(\.[a-z]{2})?$"), 3)
        .otherwise(4)
    )
    once = df.withColumn("priority", priority).groupBy("organization_id", url).agg(F.min("priority").alias("priority"), F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("organization_id").orderBy("priority", "pos", url)))


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def cap_candidates(df: DataFrame, with_site: int = 20, without: int = 10) -> DataFrame:
    """The first candidates of each organization in the order of discovery; fewer for one without a website."""
    place = F.row_number().over(Window.partitionBy("organization_id").orderBy("source_rank", "pos", "url"))
    most = F.when(F.coalesce("website_url", F.lit("")) != "", with_site).otherwise(without)
    return df.withColumn("rank", place).where(F.col("rank") <= most)


def due_sources(sources: DataFrame, now: str, n: int) -> DataFrame:
    return sources.where(F.col("next_check_at") <= F.lit(now).cast("timestamp")).orderBy("next_check_at", "source_id").limit(n)


def recent_turns(rows: DataFrame, k: int = 40, longest: int = 8000) -> DataFrame:
    """The last ``k`` user and assistant turns of each conversation, texts cut, in order."""
    said = rows.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    last = first_per_group(said, ["conv_id"], [F.desc("turn")], k, "_back")
    return last.select("conv_id", "turn", "role", F.substring("text", 1, longest).alias("text"))


def session_list(sessions: DataFrame, k: int = 100) -> DataFrame:
    """The sessions (id, user_id, updated_at, revoked_at) that are not revoked, the ``k`` newest of each user, with ``rank``."""
    return first_per_group(sessions.where("revoked_at is null"), ["user_id"], [F.desc("updated_at"), F.col("id")], k, "rank")


def sort_names(df: DataFrame, column: str, locale: str | None = None) -> DataFrame:
    """Names in order: by their lower case, or as ``locale`` has it (``UNICODE``: the root locale, or a language such as ``zh``),
    where accents and then case tell names apart only if their letters are the same; ties by the text itself."""
    if locale is None:
        return df.orderBy(F.lower(column), column)
    return df.orderBy(F.collate(F.col(column), locale), column)


def select_best_candidate(scored: DataFrame, least_pre: int = 20, k: int = 4, accept: int = 72) -> DataFrame:
    """For each entity, of its ``k`` best candidates by pre-score the one with the best confidence: accepted or candidate."""
    top = first_per_group(scored.where(F.col("pre_score") >= least_pre), ["entity_id"], [F.desc("pre_score"), F.col("pos")], k, "_pre")
    best = first_per_group(top, ["entity_id"], [F.desc("confidence"), F.col("_pre")], 1, "_best")
    return best.select("entity_id", "url", "pre_score", "confidence", F.when(F.col("confidence") >= accept, "official_verified").otherwise("candidate").alias("status"))
