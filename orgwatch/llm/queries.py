"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .audit import filter_cells, filter_interactions
from .chat import format_conversations, read_formatted
from .common import cut_lineage, table
from .extraction import extract, fit_labeller
from .langid import fit, predict
from .mixing import mix_plan, mix_totals
from .neardup import similar_documents
from .packing import pack
from .pii import pseudonymize
from .quality import score_quality
from .secrets import blob_of, findings_by_version, scan_versions
from .sharding import shard_documents
from .spelling import count_words, group_spellings


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(docs.where("not held_out"))
    return predict(docs.drop("lang"), model)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), key="a key for tests only")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_totals(mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_posterior"
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A ledger of one blob in sixteen, as of an earlier load: the second scan leaves those blobs out.
    ledger = cut_lineage(scan_versions(docs.where(F.substring(blob_of("text"), 1, 1) == "0")))
    return findings_by_version(docs, scan_versions(docs, ledger)).select("doc_id", "summary.*")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_labeller(pages))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return read_formatted(format_conversations(rows.unionByName(added)))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    none = F.lit(None).cast("int")
    return docs.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_interactions(filter_cells(docs, table(spark, sf_dir, "labels")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_sharding": op11_sharding,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL for the operators that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) AS s FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * k >= 4 * (nx.c + ny.c - k)),
        r(x, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.x, r.root FROM e JOIN r ON e.y = r.x),
        c AS (SELECT x AS doc_id, min(root) AS class_id FROM r GROUP BY 1)
        SELECT doc_id, class_id, coalesce(k, 0) AS n_links, doc_id = class_id AS kept FROM c LEFT JOIN (SELECT x, count(*) AS k FROM e GROUP BY 1) ON x = doc_id""",
    "op10_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<#:]'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    "op12_filter_interactions": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
            + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS g, coalesce(sum(toxic), 0) AS x FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY 1, 2),
        f AS (SELECT substr('ABCDE', i, 1) AS f, CAST(power(2, i - 1) AS INTEGER) AS bit FROM range(1, 6) r(i)),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
            JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, (SELECT bit FROM f WHERE f.f = substr(filter_order, step, 1)) AS bit,
            (SELECT coalesce(sum(bit), 0)::INTEGER FROM f WHERE strpos(left(filter_order, step - 1), f.f) > 0) AS before FROM o, range(1, 6) r(step)),
        a AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
            FROM s, c GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
        toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a""",
}
