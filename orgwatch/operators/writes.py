"""Writes as transformations of a table, and readers and writers of files.

Parquet has neither unique keys nor cascades; these operators keep both. Each takes the old table and gives the new one,
to be written beside the old and swapped, never over what is being read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], set_cols: list[str], pos: str = "pos") -> DataFrame:
    """Insert new keys; of known ones set ``set_cols`` only. Of several updates of a key the last by ``pos`` counts."""
    rest = [c for c in target.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rest if c in updates.columns]), pos).alias("_u"))
    old = target.withColumn("_old", F.lit(True))
    joined = old.join(last, keys, "full")
    known, new = F.col("_old"), F.col("_u").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in updates.columns:
            return F.col(c)
        return F.when(known & (~new | F.lit(c not in set_cols)), F.col(c)).otherwise(F.col(f"_u.{c}")).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Add rows whose key the target lacks, the first by ``pos`` of each key. A key with a null part conflicts with nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    keyed, loose = rows.where(whole), rows.where(~whole)
    first = keyed.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("_p = 1")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(*target.columns)).unionByName(loose.select(*target.columns))


def apply_discovery(orgs: DataFrame, results: DataFrame, overwrite: bool = False) -> DataFrame:
    """Websites found for organizations: set where there was none, or any with ``overwrite``; the status is always set."""
    found = results.select("entity_id", F.col("website_url").alias("_site"), F.lit(True).alias("_seen"))
    old = F.trim(F.coalesce("website_url", F.lit("")))
    take = F.col("_site").isNotNull() & ((old == "") | F.lit(overwrite))
    status = F.when(F.col("_seen"), F.when(F.col("_site").isNotNull(), "success").otherwise("failed")).otherwise(F.col("search_status"))
    return orgs.join(found, "entity_id", "left").withColumn("website_url", F.when(take, F.col("_site")).otherwise(F.col("website_url"))).withColumn("search_status", status).drop("_site", "_seen")


def delete_with_events(orgs: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the organizations and what hangs on them."""
    gone = ids.select("entity_id")
    return orgs.join(gone, "entity_id", "left_anti"), events.join(gone.withColumnRenamed("entity_id", "organization_id"), "organization_id", "left_anti")


def rename_if_unchanged(orgs: DataFrame, corrections: DataFrame) -> DataFrame:
    """``corrections``: entity_id, old_name, new_name. A name changes only where it still is the old one;
    of several corrections of one name the least counts."""
    new = corrections.groupBy("entity_id", F.col("old_name").alias("name")).agg(F.min("new_name").alias("new_name"))
    return orgs.join(new, ["entity_id", "name"], "left").withColumn("name", F.coalesce("new_name", "name")).select(*orgs.columns)


def reset_tracking(orgs: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    reset = {"search_status": F.lit("pending"), "event_search_status": F.lit("pending"), "last_event_searched_at": F.lit(None).cast("string")}
    return orgs.withColumns({k: v for k, v in reset.items() if k in orgs.columns}), events.where(F.lit(False))


def conform_schema(df: DataFrame, target: T.StructType, aliases: dict[str, list[str]] | None = None, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the target's columns and types: a missing one comes from an alias, else from its default."""
    aliases, defaults = aliases or {}, defaults or {}

    def column(f: T.StructField) -> Column:
        source = next((c for c in [f.name, *aliases.get(f.name, [])] if c in df.columns), None)
        value = F.col(source) if source else F.lit(defaults.get(f.name))
        value = F.coalesce(value, F.lit(defaults[f.name])) if source and f.name in defaults else value
        return value.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in target])


def required_missing(df: DataFrame, target: T.StructType, aliases: dict[str, list[str]] | None = None) -> list[str]:
    have, aliases = set(df.columns), aliases or {}
    return [f.name for f in target if not f.nullable and not have & {f.name, *aliases.get(f.name, [])}]


def chunk_lines(df: DataFrame, text: str | Column, max_bytes: int) -> DataFrame:
    """Texts cut at line ends into pieces of at most ``max_bytes`` bytes; a longer line is a piece of its own, ``oversize``.
    Adds ``piece_no`` (from 0), ``piece``, ``oversize``. A null text has no pieces."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _line_chunks(t, max_bytes))

    return df.select("*", F.posexplode(cut(text)).alias("piece_no", "piece")).withColumn("oversize", F.octet_length("piece") > max_bytes)


def _line_chunks(text: str, most: int) -> list[str]:
    """A text's pieces, in one pass over its lines."""
    pieces, begin, size, lines = [], 0, -1, text.split("\n")
    for i, line in enumerate(lines):
        n = len(line.encode("utf-8", "surrogatepass"))
        if i > begin and size + 1 + n > most:
            pieces.append("\n".join(lines[begin:i]))
            begin, size = i, -1
        size += 1 + n
    return [*pieces, "\n".join(lines[begin:])]


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def check_log_complete(log: DataFrame) -> DataFrame:
    """``log``: total, position. Rows (problem, position): more than one total, positions out of range, doubled or missing."""
    sums = log.agg(F.max("total").alias("total"), F.countDistinct("total").alias("totals"))
    counts = log.groupBy("position").count()
    every = sums.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).alias("position"))
    row = lambda df, problem: df.select(F.lit(problem).alias("problem"), F.col("position").cast("long").alias("position"))
    return (
        row(sums.where("totals > 1").withColumn("position", F.lit(None).cast("long")), "several_totals")
        .union(row(counts.where("count > 1"), "doubled")).union(row(every.join(counts, "position", "left_anti"), "missing"))
        .union(row(log.where("position < 1 or position > total").select("position").distinct(), "out_of_range"))
    )
