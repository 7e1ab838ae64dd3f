"""Clean-up jobs. Each yields a plan first, a table that can be reviewed; applying takes the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..operators import predicates as P
from ..operators.dedup import plan_org_cleanup
from ..operators.stats import with_event_count
from ..operators.views import structured_field
from ..operators.writes import delete_with_events, rename_if_unchanged


def plan_content_cleanup(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """A row (kind, id, field, before, after) for each value to change: websites that are no official domain become null,
    texts that hold JSON become the text inside, dates that are none become ``unknown``."""
    site = F.when(U.official_domain(F.col("website_url")).isNotNull(), F.col("website_url"))
    o = orgs.where(F.trim(F.coalesce("website_url", F.lit(""))) != "").select(
        F.lit("organization").alias("kind"), F.col("entity_id").cast("string").alias("id"), F.lit("website_url").alias("field"), F.col("website_url").alias("before"), site.alias("after")
    )

    def change(column: str, after) -> F.Column:
        return F.struct(F.lit(column).alias("field"), F.col(column).alias("before"), after.alias("after"))

    title = structured_field(F.col("title"), "title", F.lit("未命名事件"))
    changes = [
        change("title", title),
        change("summary", F.when(F.trim("summary").startswith("{"), structured_field(F.col("summary"), "description", title)).otherwise(F.col("summary"))),
        change("event_date", F.coalesce(D.valid_event_date(F.col("event_date")), F.lit("unknown"))),
    ]
    e = events.select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("id"), F.inline(F.array(*changes)))
    return o.unionByName(e).where("not (before <=> after)")


def apply_org_cleanup(orgs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_with_events(orgs, events, plan_org_cleanup(orgs, events))


def plan_deep_clean(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """Organizations whose website or texts break rules, or whose texts are too long, with what is to be done: ``delete`` (a
    bad website and no events), ``clear_site``, ``clear_text`` or ``summarize``."""
    none = F.array().cast("array<string>")
    rows = with_event_count(orgs, events).withColumn("website_rules", P.website_rules(F.col("website_url")))
    rows = rows.withColumn("summary_rules", F.coalesce(P.summary_rules(F.col("description")), none))
    long, site, text = F.length(F.trim(F.coalesce("description", F.lit("")))) > 2000, F.size("website_rules") > 0, F.size("summary_rules") > 0
    delete = site & (F.col("event_count") == 0)
    action = F.when(delete, "delete").when(site, "clear_site").when(text, "clear_text").otherwise("summarize")
    return rows.where(site | text | long).select("entity_id", "event_count", "website_rules", "summary_rules", action.alias("action"))


def plan_event_cleanup(events: DataFrame, rescored: DataFrame, low: int = 6) -> DataFrame:
    """(id, action, score): events with garbage words go; of those scored below ``low`` the ones that a new score lifts are
    updated, the ones that it does not go, and the ones without a new score stay."""
    bad = P.is_garbage_event(F.col("title"), F.col("summary"))
    rows = events.withColumn("_bad", bad).join(rescored.select("id", F.col("score").alias("_new")), "id", "left")
    below = F.coalesce("relevance_score", F.lit(0)) < low
    action = F.when(F.col("_bad"), "delete_rule").when(below & (F.col("_new") >= low), "update").when(below & (F.col("_new") < low), "delete_score").when(below, "keep")
    return rows.select("id", action.alias("action"), F.when(action == "update", F.col("_new")).alias("score")).where("action is not null")


def apply_name_verdicts(orgs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts``: entity_id, old_name, status, name. Corrections take effect where the name is still the old one."""
    return rename_if_unchanged(orgs, verdicts.where("status = 'CORRECTED'").select("entity_id", "old_name", F.col("name").alias("new_name")))


#: The order in which the statuses of several tags of one organization win.
TAG_PRIORITY = {"needs_retry": 4, "invalid_name": 3, "rejected_hallucination": 2, "corrected": 1}


def audit_tags(corrected: DataFrame, rejected: DataFrame, invalid: DataFrame, failed: DataFrame) -> DataFrame:
    """(name, status, detail) out of the four lists of an audit sample; a correction tags the old and the new name."""
    pair = F.concat(F.lit("suggested_name="), F.col("new_name"))
    both = corrected.select(F.explode(F.array("old_name", "new_name")).alias("name"), F.lit("corrected").alias("status"), pair.alias("detail"))
    tried = rejected.select("name", F.lit("rejected_hallucination").alias("status"), F.concat(F.lit("attempted_correction="), F.col("attempted_correction")).alias("detail"))
    bad = invalid.select("name", F.lit("invalid_name").alias("status"), F.lit("descriptive_text").alias("detail"))
    return both.union(tried).union(bad).union(failed.select("name", F.lit("needs_retry").alias("status"), F.lit("network_error").alias("detail")))


def resolve_tags(matched: DataFrame, priority: dict[str, int] = TAG_PRIORITY) -> DataFrame:
    """For each organization the winning status and all details, once each, in order."""
    order = F.create_map(*[F.lit(x) for k, v in priority.items() for x in (k, v)])
    rank = F.coalesce(F.try_element_at(order, F.col("status")), F.lit(0))
    details = F.array_join(F.array_sort(F.collect_set("detail")), "; ")
    return matched.groupBy("entity_id").agg(F.max(F.struct(rank.alias("p"), "status"))["status"].alias("cleaning_status"), details.alias("audit_note"))


def cleaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity_id, old_name, new_name, outcome) of a cleaning run: corrected, valid or invalid_or_failed."""
    both = before.select("entity_id", F.col("name").alias("old_name")).join(after.select("entity_id", F.col("name").alias("new_name")), "entity_id")
    outcome = F.when(F.col("old_name") != F.col("new_name"), "corrected").when(P.is_definitely_valid(F.col("new_name")), "valid").otherwise("invalid_or_failed")
    return both.withColumn("outcome", outcome)


def content_hash(start, end, ids) -> F.Column:
    """The digest of a window: its start, its end and the ids of its events in order."""
    return F.sha2(F.concat_ws("|", start, end, F.array_join(ids, ",")), 256)


def digest_run(events: DataFrame, orgs: DataFrame, runs: DataFrame, start: str, end: str, min_score: int = 6, n: int = 60) -> DataFrame:
    """One row for the window: event_count, content_hash of its events in order, and what to do by the ledger ``runs``
    (window_start, window_end, content_hash, status): skip, reopen or create."""
    from ..operators.topk import digest_events

    chosen = digest_events(P.recent_scored(events, start, end, min_score).join(orgs.select(F.col("entity_id").alias("organization_id")), "organization_id", "left_semi"), n)
    order = F.struct((-F.col("relevance_score")).alias("s"), F.col("created_at"), F.col("id"))
    listed = F.array_sort(F.collect_list(order), lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1).when(a["id"] < b["id"], -1).otherwise(1))
    ids = F.transform(listed, lambda x: x["id"].cast("string"))
    run = chosen.agg(F.count("*").alias("event_count"), content_hash(F.lit(start), F.lit(end), ids).alias("content_hash"))
    run = run.withColumn("window_start", F.lit(start)).withColumn("window_end", F.lit(end))
    known = runs.select("window_start", "window_end", "content_hash", F.col("status").alias("_status"))
    action = F.when(F.col("_status").isin("running", "generated", "pushed"), "skip").when(F.col("_status").isNotNull(), "reopen").otherwise("create")
    return run.join(known, ["window_start", "window_end", "content_hash"], "left").withColumn("action", action).drop("_status")


def render_digest(events: DataFrame) -> DataFrame:
    """One text: numbered items by score with their organization, and a link where it is http(s)."""
    link = F.when(F.col("source_url").rlike("^https?://"), F.concat(F.lit("\n"), F.col("source_url"))).otherwise("")
    item = F.struct((-F.col("relevance_score")).alias("s"), F.col("id"), F.concat(F.lit(". ["), F.coalesce("organization_name", F.lit("-")), F.lit("] "), F.col("title"), link).alias("t"))
    items = F.array_sort(F.collect_list(item))
    return events.agg(F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), x["t"])), "\n").alias("digest"), F.count("*").alias("n"))


def apply_translations(df: DataFrame, results: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Set target columns from results where there is a text; ``columns``: target to result column."""
    named = results.select(key, *[F.col(r).alias(f"_{t}") for t, r in columns.items()])
    joined = df.join(named, key, "left")
    return joined.withColumns({t: F.coalesce(F.when(F.trim(f"_{t}") != "", F.col(f"_{t}")), F.col(t)) for t in columns}).drop(*[f"_{t}" for t in columns])


def parse_score(c) -> F.Column:
    """A score out of a model's answer: any of three spellings of its key, else the first number after the word score."""
    keys = [F.get_json_object(c, f"$.{k}").try_cast("double") for k in ("relevance_score", "relevanceScore", "score")]
    return F.coalesce(*keys, F.regexp_extract(c, r"(?i)score\D{0,10}([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))


def context_body(c, n: int) -> F.Column:
    """Paragraphs joined until ``n`` characters are reached; only the first may be cut."""

    def add(at, p):
        longer = F.concat(at["t"], F.lit("\n"), p)
        fits = ~at["full"] & (F.length(longer) <= n)
        first = at["t"] == ""
        return F.struct(F.when(first, F.substring(p, 1, n)).when(fits, longer).otherwise(at["t"]).alias("t"), F.when(first, F.length(p) > n).otherwise(at["full"] | ~fits).alias("full"))

    parts = F.filter(F.transform(F.split(c, r"\n+"), T.collapse_ws), lambda p: p != "")
    return F.aggregate(parts, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), add, lambda at: at["t"])


def context_block(df, n: int = 6000, least: int = 160):
    """Adds ``context_block`` to rows (title, published, domain, body): three header lines and the body; null where the body has
    less than ``least`` characters."""
    body = context_body(F.col("body"), n)
    head = [F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(d))) for k, c, d in (("title", "title", ""), ("published_at", "published", "unknown"), ("source_domain", "domain", ""))]
    return df.withColumn("context_block", F.when(F.length(body) >= least, F.concat_ws("\n", *head, F.lit("body:"), body)))


def audit_report(orgs: DataFrame, before: DataFrame) -> DataFrame:
    """(list, name, detail), once each: organizations by cleaning status; of a correction the old name and the new one, of a
    rejected one what was tried."""
    old = before.select("entity_id", F.col("name").alias("_old"))
    s, note = F.lower("cleaning_status"), F.col("audit_note")
    kind = (
        F.when(s == "corrected", "corrected").when(s == "rejected_hallucination", "rejected").when(s == "invalid_name", "invalid")
        .when(s.isin("needs_retry", "api_timeout", "network_error"), "failed").when(s.isin("valid", "valid_confirmed"), "valid")
    )
    tried = F.trim(F.regexp_extract(note, r"(?i)(?:rejected hallucinated correction:|attempted_correction\s*=)\s*([^;]+)", 1))
    detail = F.when(kind == "corrected", F.coalesce(T.note_field(note, "suggested_name"), "name")).when(kind == "rejected", F.nullif(tried, F.lit("")))
    named = F.when(kind == "corrected", F.coalesce("_old", "name")).otherwise(F.col("name"))
    return orgs.join(old, "entity_id", "left").select(kind.alias("list"), named.alias("name"), detail.alias("detail")).where("list is not null").distinct()
