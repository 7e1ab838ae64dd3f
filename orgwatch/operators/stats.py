"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from . import predicates as P


def totals(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the number of organizations and of events."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return one(orgs, "o").union(one(events, "e")).agg(count("o").alias("organizations"), count("e").alias("events"))


def domain_stats(orgs: DataFrame) -> DataFrame:
    """Organizations by the suffix of their website's host, most first."""
    sites = orgs.where(F.trim(F.coalesce("website_url", F.lit(""))) != "").select(U.domain_suffix(F.col("website_url")).alias("suffix"))
    return sites.where("suffix is not null").groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix")


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_event_count(orgs: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy(F.col("organization_id").alias("entity_id")).agg(F.count("*").alias("event_count"))
    return orgs.join(counts, "entity_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def quality_report(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """Metric rows over all organizations."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    counted = with_event_count(orgs, events)
    flags = {
        "total": F.lit(True), "missing_name": blank("name"), "short_name": ~blank("name") & (F.length(F.trim("name")) < 2),
        "no_site_no_description": blank("website_url") & blank("description"), "zero_events": F.col("event_count") == 0,
    }
    one = counted.agg(*[F.count_if(v).alias(k) for k, v in flags.items()])
    rows = one.select(F.explode(F.create_map(*[x for k in flags for x in (F.lit(k), F.col(k))])).alias("metric", "value"))
    doubled = duplicate_groups(orgs, "name").agg(F.count("*").alias("value")).select(F.lit("duplicate_names").alias("metric"), "value")
    return rows.unionByName(doubled)


def name_report(orgs: DataFrame) -> DataFrame:
    n = F.col("name")
    marked = n.rlike("|".join(P.NAME_MARKERS))
    return orgs.agg(F.count("*").alias("total"), F.count_if(F.length(n) > 20).alias("long_names"), F.count_if(marked).alias("marked_names"), F.count_if(P.is_suspicious_name(n)).alias("suspicious"))


def source_health_counts(state: DataFrame) -> DataFrame:
    c = F.col("retry_class")
    return state.agg(F.count_if(c.isin("retry", "backoff")).alias("retryable"), F.count_if(c == "reprobe").alias("reprobe"))


def run_stats(results: DataFrame, status: str = "status") -> DataFrame:
    """Results by status; a site whose news were verified counts as verified too."""
    c = F.col(status)
    return results.agg(
        F.count("*").alias("total"), F.count_if(c.isin("official_verified", "news_verified")).alias("official_verified"), F.count_if(c == "news_verified").alias("news_verified"),
        F.count_if(c == "candidate").alias("candidate"), F.count_if(c == "not_found").alias("not_found"), F.count_if(c == "failed").alias("failed"),
    )


def skip_summary(skipped: DataFrame, reason: str, sample: str, k: int = 10) -> DataFrame:
    """Reasons by count and then name, each with its first samples."""
    counts = skipped.groupBy(reason).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(reason).orderBy(sample))
    some = skipped.withColumn("_p", place).where(F.col("_p") <= k).groupBy(reason).agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    return counts.join(some, reason).orderBy(F.desc("n"), reason)


def event_funnel(found: DataFrame, kept: DataFrame, inserted: DataFrame, key: str = "organization_id") -> DataFrame:
    """For each organization how many candidates were found, kept and inserted."""
    marked = [df.select(key, *[F.lit(int(i == at)).alias(n) for i, n in enumerate(("found", "kept", "inserted"))]) for at, df in enumerate((found, kept, inserted))]
    return marked[0].union(marked[1]).union(marked[2]).groupBy(key).agg(*[F.sum(n).alias(n) for n in ("found", "kept", "inserted")])


def page_info(df: DataFrame, number: int, limit: int) -> DataFrame:
    total = F.count("*")
    pages = F.ceil(total / limit)
    return df.agg(total.alias("total"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def failure_reason(c: Column) -> Column:
    m = F.coalesce(c, F.lit(""))
    return (
        F.when(m.rlike("(?i)timeout|timed out"), "network_timeout").when(m.rlike("(?i)network|fetch failed|ECONN|ENOTFOUND"), "network_error")
        .when(m.rlike("(?i)llm_parse_failed"), "llm_parse_failed").when(m.rlike("(?i)no valid source"), "no_valid_source").otherwise("processing_failed")
    )


def run_manifest(results: DataFrame) -> DataFrame:
    """(list, entity_id, reason) of a run's results (entity_id, error): ``success`` without an error, else ``failed`` with the
    class of its last error by text."""
    last = results.groupBy("entity_id").agg(F.max("error").alias("error"))
    failed = F.col("error").isNotNull()
    return last.select(F.when(failed, "failed").otherwise("success").alias("list"), "entity_id", F.when(failed, failure_reason(F.col("error"))).alias("reason"))


def plan_summary(plan: DataFrame, events: DataFrame) -> DataFrame:
    """For each rule of a clean-up plan the rows it takes and the events that would go with them."""
    return with_event_count(plan, events).groupBy("rule").agg(F.count("*").alias("n"), F.sum("event_count").alias("events"))
