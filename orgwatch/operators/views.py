"""Projections of the tables, with their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T


def structured_field(c: Column, field: str, fallback: Column) -> Column:
    """A text that is a JSON object (text after it is ignored) gives its field; a broken object gives the field as far as
    it can be read; another text gives itself; a blank one the fallback."""
    t = F.trim(F.coalesce(c, F.lit("")))
    rescued = F.regexp_extract(t, rf'"{field}"\s*:\s*"((?:\\.|[^"\\])*)', 1)
    inside = F.trim(F.coalesce(F.get_json_object(t, f"$.{field}"), F.regexp_replace(rescued, r'\\(["\\/])', "$1")))
    return F.when(t.startswith("{"), F.when(inside != "", inside).otherwise(fallback)).when(t != "", t).otherwise(fallback)


def organization_view(df: DataFrame) -> DataFrame:
    status = lambda c: F.when(F.col(c).isin("success", "failed"), F.col(c)).otherwise("pending").alias(c)
    made = {
        "source_count": F.coalesce("source_count", F.lit(0)), "mention_count": F.coalesce("mention_count", F.lit(1)), "search_status": status("search_status"),
        "event_search_status": status("event_search_status"), "cleaning_status": F.coalesce("cleaning_status", F.lit("unreviewed")), "sources": F.coalesce("sources", F.lit("[]")),
    }
    return df.withColumns({k: v for k, v in made.items() if k in df.columns})


def event_view(df: DataFrame, untitled: str = "未命名事件") -> DataFrame:
    """Title and description cleaned, translations with their fallbacks, a date or ``unknown``."""
    title = structured_field(F.col("title"), "title", F.lit(untitled))
    return df.select(
        "id", "organization_id", title.alias("title"),
        structured_field(F.coalesce("translated_title", "title"), "title", title).alias("translated_title"),
        structured_field(F.coalesce("translated_description", "summary"), "description", F.coalesce("summary", title)).alias("translated_description"),
        F.coalesce(D.valid_event_date(F.col("event_date")), F.lit("unknown")).alias("event_date"),
        F.coalesce(F.col("relevance_score").cast("int"), F.lit(0)).alias("relevance_score"), "event_type", "source_url", "created_at",
    )


def event_list_view(df: DataFrame) -> DataFrame:
    """The public row of an event joined with its organization's name and slug."""
    title = structured_field(F.col("title"), "title", F.lit("未命名事件"))
    return df.select(
        "id", "organization_id", "organization_name", "organization_slug",
        structured_field(F.coalesce("translated_title", "title"), "title", title).alias("title"),
        structured_field(F.coalesce("translated_description", "summary"), "description", F.coalesce("summary", title)).alias("description"),
        D.valid_event_date(F.col("event_date")).alias("event_date"), T.category(F.col("event_type")).alias("category"), "source_url",
    )


def insight_view(df: DataFrame) -> DataFrame:
    title = structured_field(F.col("title"), "title", F.lit("未命名事件"))
    told = F.coalesce("translated_description", "summary", "translated_title")
    fallback = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.trim("summary")).otherwise(title)
    return df.select(
        "id", "organization_id", structured_field(told, "description", fallback).alias("description"),
        D.valid_event_date(F.col("event_date")).alias("event_date"), T.category(F.col("event_type")).alias("category"), "source_url",
    )


PUBLIC = {
    "organizations": ["entity_id", "slug", "name", "description", "website_url"],
    "events": ["id", "organization_id", "title", "event_date", "event_type", "relevance_score", "source_url"],
}


def public_columns(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[c for c in PUBLIC[kind] if c in df.columns])


def normalize_input(df: DataFrame, kind: str) -> DataFrame:
    """Trim incoming texts and fill the defaults of the kind."""
    defaults = {"events": {"event_type": "other"}, "organizations": {"entity_type": "institution", "region": "unknown", "country": "unknown"}}[kind]
    trimmed = {c: F.trim(F.col(c)) for c, t in df.dtypes if t == "string"}
    filled = {c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", d).otherwise(F.trim(F.col(c))) for c, d in defaults.items() if c in df.columns}
    return df.withColumns(trimmed | filled)


def session_view(df: DataFrame, longest: int = 30, untitled: str = "新对话") -> DataFrame:
    """A row for each conversation of the table (conv_id, turn, role, text): its title is the first user text, cut."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    t = T.collapse_ws(F.coalesce(first, F.lit("")))
    return df.groupBy("conv_id").agg(F.when(t != "", F.substring(t, 1, longest)).otherwise(untitled).alias("title"), F.count("*").alias("n_messages"))
