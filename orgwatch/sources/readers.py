"""Readers. Files of any shape are read as text and taken apart by expressions, so that odd records do not stop a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

WHITELIST = "name string, code string, aliases array<string>, official_domain string, domain string"


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, domain) of a JSON list of names or of objects, bare or under ``organizations``; blank names go."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = whole.select(F.coalesce(F.try_variant_get("v", "$.organizations", "variant"), F.col("v")).alias("v"))
    rows = items.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    text = lambda p: F.try_variant_get("value", p, "string")
    name = F.coalesce(F.nullif(F.trim(text("$.name")), F.lit("")), F.trim(text("$.code")), F.when(~F.to_json("value").startswith("{"), F.trim(text("$"))))
    return rows.select("pos", name.alias("name"), F.coalesce(text("$.official_domain"), text("$.domain")).alias("domain")).where("name <> ''")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    schema = f"organizations array<struct<{WHITELIST.replace(' ', ':').replace(',:', ',')}>>, institutions array<struct<{WHITELIST.replace(' ', ':').replace(',:', ',')}>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    rows = files.select(F.posexplode(F.coalesce("organizations", "institutions")).alias("pos", "e"))
    return rows.select("pos", "e.name", "e.code", "e.aliases", F.coalesce("e.official_domain", "e.domain").alias("domain"))


def discovered_urls(df: DataFrame, k: int = 12) -> DataFrame:
    """Adds ``urls``: candidates and source URLs, http(s) only, once each, the first ``k``."""
    both = F.array_union(F.coalesce("candidates", F.array().cast("array<string>")), F.coalesce(F.transform("sources", lambda s: s["url"]), F.array().cast("array<string>")))
    return df.withColumn("urls", F.slice(F.array_distinct(F.filter(both, lambda u: u.rlike("(?i)^https?://"))), 1, k))


def read_source_index(spark: SparkSession, path: str, k: int = 12) -> DataFrame:
    """(key, urls) of a file of discovered sources: the URLs of each name, in lower case; of a name told twice the last counts."""
    schema = "organizations array<struct<name:string, candidates:array<string>, sources:array<struct<url:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("organizations").alias("pos", "r"))
    last = rows.groupBy(F.lower(F.trim("r.name")).alias("key")).agg(F.max_by("r", "pos").alias("r")).where("key <> ''")
    return discovered_urls(last.select("key", "r.candidates", "r.sources"), k).select("key", "urls")


#: The columns of stored tables, all text but for those named with a type.
TABLES = {
    "organizations": "entity_id slug name description entity_type is_core_tracking:boolean region country founded analysis_type related_types mention_count:int"
    " credibility_score:int source source_count:int context source_location source_document original_name location_basis location_confidence summary website_url"
    " sources last_searched_at search_status last_event_searched_at event_search_status cleaning_status audit_note retry_count:int created_at updated_at",
    "events": "id organization_id event_date event_type relevance_score:int title summary translated_title translated_description source_url canonical_source_url"
    " source_name created_at",
    "news_sources": "id organization_slug name url interval_minutes:int etag last_modified last_content_hash failure_count:int last_fetch_status retry_class"
    " last_checked_at next_check_at next_retry_at",
    "briefing_runs": "id window_start window_end event_count:int content_hash status generated_at pushed_at error",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its full list of columns; those that its files lack are null."""
    typed = [c if ":" in c else f"{c}:string" for c in TABLES[name].split()]
    return spark.read.schema(", ".join(c.replace(":", " ") for c in typed)).parquet(f"{root}/{name}")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """(id, error) of a JSON-lines log; lines that are no JSON object with an id are skipped, the last of an id counts: in the
    file written last, the line furthest on."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.from_json("value", "id string, error string").alias("r"), at.alias("line"))
    return lines.where("r.id is not null").groupBy("r.id").agg(F.max_by("r.error", "line").alias("error"))


def parse_cleaning_line(line: Column) -> Column:
    """(position, total, outcome, name, detail) of a line of the cleaning log, null for other lines. Lines begin with
    ``[进度 n/m]``; then a name settled at once, a completed one with its outcome, a failed one with its reason, or a
    correction that was not supported."""
    head = r"^\[进度\s+([0-9]+)/([0-9]+)\]\s+"
    body = F.trim(F.regexp_replace(line, head, ""))
    part = lambda p, g: F.trim(F.regexp_extract(body, p, g))
    short, done = r"^(.*?)\s+->\s+VALID\s+\(short-circuit\)$", r"^完成:\s+(.*?)\s+->\s+(VALID|INVALID|CORRECTED)(?:\s+\((.*)\))?$"
    failed, refused = r"^失败:\s+(.*?)\s+\((api_timeout|network_error|llm_parse_failed)\)$", r"^拒绝不受支持的纠正:\s+(.*?)\s+->\s+(.*?)$"
    row = lambda outcome, name, detail: F.struct(
        F.regexp_extract(line, head, 1).try_cast("long").alias("position"), F.regexp_extract(line, head, 2).try_cast("long").alias("total"),
        outcome.alias("outcome"), name.alias("name"), F.nullif(detail, F.lit("")).alias("detail"),
    )
    found = (
        F.when(body.rlike(short), row(F.lit("valid"), part(short, 1), F.lit(""))).when(body.rlike(done), row(F.lower(part(done, 2)), part(done, 1), part(done, 3)))
        .when(body.rlike(failed), row(F.lit("failed"), part(failed, 1), part(failed, 2))).when(body.rlike(refused), row(F.lit("rejected"), part(refused, 1), part(refused, 2)))
    )
    return F.when(line.rlike(head), found)


def read_cleaning_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_cleaning_line(F.col("value")).alias("r")).where("r is not null").select("r.*")


def safe_domain(df: DataFrame, column: str = "domain") -> DataFrame:
    return df.withColumn(column, U.official_domain(F.col(column)))
