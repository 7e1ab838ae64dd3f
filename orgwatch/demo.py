"""Organizations, events and logs derived from the driver's tables, with the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls as U
from .storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the host of their URL."""
    return table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organization for each host of a page."""
    # Told once, so that its size is known: only the texts that are asked for are joined, the others never move.
    hosts = written(pages(spark, sf_dir).groupBy("host").agg(F.min("page_id").alias("doc_id")))
    n, h = F.length("host"), F.col("host")
    site = F.when(n % 4 == 0, "https://elsewhere.example.org/").when(n % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://"), h))
    text = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    return hosts.join(text.join(hosts.select("doc_id"), "doc_id", "left_semi"), "doc_id", "left").select(
        F.concat(F.lit("org-"), h).alias("entity_id"), h.alias("slug"), F.try_element_at(F.split(h, r"\."), F.lit(-3)).alias("name"), site.alias("website_url"), "description"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each page, told at the time of the event with its id. Of a page only what is read out of it is joined."""
    ts = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), "ts")
    p = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("news", "announcement", "research report", "media", "partnership")]), (p % 5 + 1).cast("int"))
    read = pages(spark, sf_dir).select(
        "page_id", "url", "host", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<p>([^<]*)</p>", 1).alias("summary")
    )
    return read.join(ts, "page_id").select(
        p.alias("id"), F.concat(F.lit("org-"), F.col("host")).alias("organization_id"), "title", "summary", F.lit(None).cast("string").alias("translated_title"), F.lit(None).cast("string").alias("translated_description"),
        F.when(p % 11 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"), kind.alias("event_type"), (p % 10 + 1).cast("int").alias("relevance_score"),
        F.col("url").alias("source_url"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations whose names repeat, some bare of description and website."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("org-"), k.cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("makes "), F.col("p_type"))).alias("description"),
        F.when(k % 4 != 0, F.concat(F.lit("https://p"), k.cast("string"), F.lit(".example.com/"))).alias("website_url"), F.col("p_brand").alias("slug"),
    )


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each order, of the organization with the customer's number; there are more parts than customers, so
    that some organizations have no events."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("org-"), F.col("o_custkey").cast("string")).alias("organization_id"), F.floor(F.col("o_totalprice") / 10_000).cast("int").alias("relevance_score")
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of fetches of sources."""
    status = F.create_map(*[F.lit(x) for k, v in {"purchase": 200, "click": 403, "view": 404, "signup": 429, "error": 500}.items() for x in (k, v)])
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fetch_id"), F.col("user_id").alias("source_id"), "ts", F.try_element_at(status, kind).alias("status"), F.when(kind == "error", "ETIMEDOUT").alias("error_code")
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"))


# The same views in DuckDB SQL. -----------------------------------------------------------------------------------

_URL = U.URL.replace("'", "''")


def sql_part(c: str, group: int) -> str:
    return f"regexp_extract({c}, '{_URL}', {group})"


def sql_host(c: str) -> str:
    return f"nullif(regexp_replace(lower({sql_part(c, 3)}), '^www\\.', ''), '')"


SQL_VIEWS = {
    "v_page": f"SELECT *, {sql_host('url')} AS host FROM pages",
    "v_org": """SELECT 'org-' || host AS entity_id, host AS slug, list_extract(string_split(host, '.'), -3) AS name,
        CASE WHEN length(host) % 4 = 0 THEN 'https://elsewhere.example.org/' WHEN length(host) % 9 = 0 THEN NULL ELSE 'https://' || host END AS website_url,
        d.text AS description
        FROM (SELECT host, min(page_id) AS pid FROM v_page GROUP BY host) h LEFT JOIN documents d ON d.doc_id = h.pid""",
    "v_event": """SELECT page_id AS id, 'org-' || host AS organization_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_extract(html, '<p>([^<]*)</p>', 1) AS summary, CAST(NULL AS VARCHAR) AS translated_title, CAST(NULL AS VARCHAR) AS translated_description,
        CASE WHEN page_id % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS event_date,
        list_extract(['news', 'announcement', 'research report', 'media', 'partnership'], page_id % 5 + 1) AS event_type,
        CAST(page_id % 10 + 1 AS INTEGER) AS relevance_score, url AS source_url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM v_page JOIN (SELECT event_id, ts FROM events) e ON e.event_id = page_id""",
    "v_named": """SELECT 'org-' || p_partkey AS entity_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'makes ' || p_type END AS description,
        CASE WHEN p_partkey % 4 <> 0 THEN 'https://p' || p_partkey || '.example.com/' END AS website_url, p_brand AS slug FROM part""",
    "v_named_event": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'org-' || o_custkey AS organization_id, CAST(floor(o_totalprice / 10000) AS INTEGER) AS relevance_score
        FROM orders""",
    "v_fetch": """SELECT event_id AS fetch_id, user_id AS source_id, ts,
        CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 403 WHEN 'view' THEN 404 WHEN 'signup' THEN 429 WHEN 'error' THEN 500 END AS status,
        CASE WHEN event_type = 'error' THEN 'ETIMEDOUT' END AS error_code FROM events""",
    "v_supplier": """SELECT s_suppkey AS entity_id, s_name AS name, n_name AS country, r_name AS region, s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
_NEEDS = {"v_org": ["v_page"], "v_event": ["v_page"]}


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front."""
    used = [v for v in SQL_VIEWS if f"{v} " in f"{sql} ".replace(")", " ").replace(",", " ").replace("\n", " ")]
    used = list(dict.fromkeys(x for v in used for x in (*_NEEDS.get(v, []), v)))
    if not used:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in used) + ("\n" + sql if not sql.lstrip().upper().startswith("WITH ") else ",\n" + sql.lstrip()[5:])
