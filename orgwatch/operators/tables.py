"""Writes into stored tables that touch only what changes.

A keyed table is cut into buckets by a hash of its key, each a partition of its own that holds one bucket file, so Spark
knows where each key lies: a write reads the buckets of its keys, joins them without moving a row of the table (only the
updates are shuffled), and overwrites these partitions alone. What is written is staged in the shared folder first and takes
the place of the old partitions when a second job commits it, so a job that fails leaves the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir
from . import writes

PART = "key_bucket"


def _part(keys: list[str], buckets: int) -> Column:
    """The bucket of a key, as Spark's own bucketing numbers it."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def create_keyed_table(df: DataFrame, name: str, keys: list[str], buckets: int = 256) -> None:
    """A new table of ``df`` in ``buckets`` partitions by key."""
    dealt = df.withColumn(PART, _part(keys, buckets)).repartition(buckets, *keys)
    dealt.write.partitionBy(PART).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)


def read_keyed_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(PART)


def _rewritten(spark: SparkSession, name: str, keys: list[str], changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Overwrite the buckets of the keys in ``changes`` with what ``change`` makes of their rows; how many there are."""
    buckets = _buckets(spark, name)
    touched = [r[0] for r in changes.select(_part(keys, buckets)).distinct().collect()]  # at most as many as buckets
    if not touched:
        return 0
    table = spark.table(name)
    new = change(table.where(F.col(PART).isin(touched)).drop(PART)).withColumn(PART, _part(keys, buckets))
    _put(spark, name, new.select(*table.columns))
    return len(touched)


def _put(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Overwrite the partitions of ``rows``. The setting that spares the others is made in a session of its own."""
    staged = f"{shared_dir(spark)}/orgwatch-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    own.read.schema(rows.schema).parquet(staged).write.mode("overwrite").insertInto(name)
    spark.catalog.refreshTable(name)


def _buckets(spark: SparkSession, name: str) -> int:
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return int(told["Num Buckets"])


def upsert_table(spark: SparkSession, name: str, updates: DataFrame, keys: list[str], set_cols: list[str], pos: str = "pos") -> int:
    """``writes.upsert`` into a stored table; the number of buckets that were rewritten."""
    return _rewritten(spark, name, keys, updates, lambda old: writes.upsert(old, updates, keys, set_cols, pos))


def insert_ignore_table(spark: SparkSession, name: str, rows: DataFrame, keys: list[str], pos: str = "pos") -> int:
    """``writes.insert_ignore`` into a stored table; only buckets that get a row are rewritten."""
    known = spark.table(name).select(*keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    new = rows.where(~whole).unionByName(rows.where(whole).join(known, keys, "left_anti"))
    return _rewritten(spark, name, keys, new, lambda old: writes.insert_ignore(old, new, keys, pos))


def delete_from_table(spark: SparkSession, name: str, keys: list[str], gone: DataFrame) -> int:
    """Rows of a stored table whose key is in ``gone`` go; only buckets that hold such a row are rewritten. An emptied bucket
    keeps a row count of none: its partition is dropped."""
    held = spark.table(name).select(*keys).join(gone.select(*keys), keys, "left_semi")
    buckets = _buckets(spark, name)
    before = {r[0] for r in held.select(_part(keys, buckets)).distinct().collect()}
    if not before:
        return 0
    left = spark.table(name).where(F.col(PART).isin(sorted(before))).join(gone.select(*keys), keys, "left_anti")
    kept = {r[0] for r in left.select(PART).distinct().collect()}
    if kept:
        _put(spark, name, left.select(*spark.table(name).columns))
    for part in sorted(before - kept):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({PART} = {part})")
    return len(before)


def delete_with_events_tables(spark: SparkSession, orgs: str, events: str, ids: DataFrame) -> tuple[int, int]:
    """``writes.delete_with_events`` on stored tables, keyed by ``entity_id`` and ``organization_id``: the events first, so that a
    job that stops between the two leaves organizations without events, never events without an organization."""
    gone = ids.select("entity_id").distinct()
    events_gone = delete_from_table(spark, events, ["organization_id"], gone.withColumnRenamed("entity_id", "organization_id"))
    return delete_from_table(spark, orgs, ["entity_id"], gone), events_gone
