"""Stored tables: writes rewrite the buckets of their keys alone, a failed write leaves the table as it was."""

import datetime
import os
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orgwatch.operators import tables, writes
from orgwatch.streaming import health


@pytest.fixture
def stored(spark):
    """A keyed table of 500 rows in 16 buckets."""
    name = f"t{uuid.uuid4().hex[:8]}"
    df = spark.range(500).selectExpr("concat('org-', id) as entity_id", "concat('name ', id % 400) as name", "case when id % 3 = 0 then 'd' end as description")
    tables.create_keyed_table(df, name, ["entity_id"], 16)
    yield name, df
    spark.sql(f"DROP TABLE {name}")


def files(spark, name):
    at = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / name
    return {str(p): os.stat(p).st_mtime_ns for p in at.rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_rewrites_its_buckets(spark, stored):
    name, df = stored
    updates = spark.createDataFrame([("org-7", "seven", "x", 1), ("org-7", "sieben", "y", 2), ("new-1", "new", "z", 1)], "entity_id string, name string, description string, pos int")
    want = rows(writes.upsert(df, updates, ["entity_id"], ["name"]))
    before = files(spark, name)
    assert len(before) == 16
    n = tables.upsert_table(spark, name, updates, ["entity_id"], ["name"])
    assert n == 2 and rows(tables.read_keyed_table(spark, name)) == want
    after = files(spark, name)
    assert len(set(before) & set(after)) == 14 and len(after) == 16
    assert tables.upsert_table(spark, name, updates.where("false"), ["entity_id"], ["name"]) == 0


def test_target_is_not_shuffled(spark, stored):
    name, _ = stored
    updates = spark.createDataFrame([(f"org-{i}", "n", "x", 1) for i in range(40)], "entity_id string, name string, description string, pos int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = writes.upsert(spark.table(name).where(F.col(tables.PART).isin(1, 2, 3)).drop(tables.PART), updates, ["entity_id"], ["name"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in above, plan


def test_failed_write_changes_nothing(spark, stored):
    name, df = stored
    updates = spark.createDataFrame([(f"org-{i}", "n", "x", 1) for i in range(200)], "entity_id string, name string, description string, pos int")
    before = files(spark, name)
    broken = updates.withColumn("name", F.when(F.col("entity_id") == "org-150", F.raise_error(F.lit("stop"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="stop"):
        tables.upsert_table(spark, name, broken, ["entity_id"], ["name"])
    assert files(spark, name) == before and rows(tables.read_keyed_table(spark, name)) == rows(df)
    tables.upsert_table(spark, name, updates, ["entity_id"], ["name"])  # and the same again, mended
    assert rows(tables.read_keyed_table(spark, name)) == rows(writes.upsert(df, updates, ["entity_id"], ["name"]))


def test_insert_ignore(spark, stored):
    name, df = stored
    more = spark.createDataFrame([("org-1", "kept", "x", 1), ("new", "first", "x", 1), ("new", "second", "x", 2), (None, "loose", "x", 1)], "entity_id string, name string, description string, pos int")
    before = files(spark, name)
    assert tables.insert_ignore_table(spark, name, more, ["entity_id"]) == 2
    assert rows(tables.read_keyed_table(spark, name)) == rows(writes.insert_ignore(df, more, ["entity_id"]))
    assert len(set(before) & set(files(spark, name))) >= 14
    assert tables.insert_ignore_table(spark, name, more.where("entity_id = 'org-1'"), ["entity_id"]) == 0


def test_delete_cascades(spark, stored):
    name, df = stored
    events = f"e{uuid.uuid4().hex[:8]}"
    told = spark.range(900).selectExpr("id", "concat('org-', id % 300) as organization_id")
    tables.create_keyed_table(told, events, ["organization_id"], 8)
    gone = spark.createDataFrame([("org-3",), ("org-450",), ("other",), ("org-3",)], "entity_id string")
    want = [rows(x) for x in writes.delete_with_events(df, told, gone)]
    before = files(spark, name)
    tables.delete_with_events_tables(spark, name, events, gone)
    assert rows(tables.read_keyed_table(spark, name)) == want[0]
    assert rows(tables.read_keyed_table(spark, events).select("organization_id", "id")) == want[1]
    assert len(set(before) & set(files(spark, name))) >= 14
    every = tables.read_keyed_table(spark, name).select("entity_id")
    tables.delete_from_table(spark, name, ["entity_id"], spark.createDataFrame(every.collect(), "entity_id string"))
    assert tables.read_keyed_table(spark, name).count() == 0
    spark.sql(f"DROP TABLE {events}")


SCHEMA = "fetch_id int, source_id int, ts timestamp_ntz, status int, error_code string"


def test_state_stream_writes_what_a_batch_touches(spark, tmp_path):
    """Many sources, small batches: each batch writes the buckets of its own sources; old versions go; a replay changes nothing."""
    draw, at = random.Random(1), datetime.datetime(2026, 1, 1)
    log, state = [], str(tmp_path / "state")
    batches = [[(i, i, at, 200, None) for i in range(300)]] + [[(1000 * b + i, draw.randint(0, 310), at + datetime.timedelta(minutes=b), draw.choice([200, 404]), None) for i in range(3)] for b in range(1, 6)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    for b, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = health.source_state_stream(stream, state, str(tmp_path / "cp"), buckets=32).start()
        q.processAllAvailable()
        q.stop()
        log += batch
        new = list((tmp_path / "state/data" / f"version={b}").rglob("*.parquet"))
        sizes.append(len({p.parent for p in new}))
        got = {r.source_id: (r.last.fetch_id, r.failure_count, r.success_count) for r in health.read_source_state(spark, state).collect()}
        want = {}
        for f, s, t, code, _ in log:
            old = want.get(s, ((datetime.datetime.min, -1), 0, 0))
            want[s] = (max(old[0], (t, f)), old[1] + 1, old[2] + (code == 200))
        assert got == {s: (last[1], n, ok) for s, (last, n, ok) in want.items()}
    assert sizes[0] == 32 and all(1 <= n <= 3 for n in sizes[1:])
    held = [p.parent for p in (tmp_path / "state/data").rglob("*.parquet")]
    assert len(held) <= 32 + 2 * 3 and len(list((tmp_path / "state/manifest").iterdir())) == 2
    seen = rows(health.read_source_state(spark, state))
    last = sorted((tmp_path / "cp/commits").iterdir(), key=lambda p: p.name.strip(".").split(".")[0])
    for p in last:
        if p.name in (str(len(batches) - 1), f".{len(batches) - 1}.crc"):
            p.unlink()  # the last batch was written, but not committed
    q = health.source_state_stream(stream, state, str(tmp_path / "cp"), buckets=32).start()
    q.processAllAvailable()
    q.stop()
    assert rows(health.read_source_state(spark, state)) == seen
