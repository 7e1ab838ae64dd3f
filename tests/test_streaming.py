"""The stream forms give what the batch forms give."""

import datetime

from orgwatch.streaming import health

SCHEMA = "k string, n int, ts timestamp"


def test_admission_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = datetime.datetime(2026, 1, 1)
    rows = [(k, i, at + datetime.timedelta(seconds=s)) for k in "ab" for i, s in enumerate((0, 5, 10, 20, 59, 60, 61, 70, 130, 131, 132, 133))]
    parts = [[r for r in rows if r[1] < 6], [r for r in rows if r[1] >= 6]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = health.admit_stream(stream, "k", "ts", 3, 60)
    q = out.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, r.n, r.admitted) for r in spark.table("admitted").collect())
    want = sorted((r.k, r.n, r.admitted) for r in health.admit(spark.createDataFrame(rows, SCHEMA), "k", "ts", 3, 60).collect())
    assert got == want and sum(not a for _, _, a in got) == 6


def test_folds_do_not_depend_on_partitions(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(f"k{i % 7}", i, at + datetime.timedelta(seconds=(i * 37) % 900)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = [sorted((r.k, r.n, r.admitted) for r in health.admit(df.repartition(n), "k", "ts", 4, 100).collect()) for n in (1, 5)]
    assert seen[0] == seen[1]


def test_null_keys_and_large_ids(spark):
    """Null keys are one key, a row without a time never passes, and no id changes beside a null."""
    at = datetime.datetime(2026, 1, 1)
    big = 9007199254740993
    rows = [(None, i, at + datetime.timedelta(seconds=i)) for i in range(5)] + [(big, None, at), (big, 7, at), (big, 8, at), (big, 9, None)]
    log = spark.createDataFrame(rows, "k long, n long, ts timestamp")
    got = [tuple(r) for r in health.admit(log.coalesce(1), "k", "ts", 2, 60).collect()]
    assert sorted(map(str, [r[:3] for r in got])) == sorted(map(str, rows))
    assert sorted(r[1] for r in got if r[0] is None and r[3]) == [0, 1]
    assert sum(r[3] for r in got if r[0] == big) == 2 and not [r for r in got if r[2] is None and r[3]]
    cool = spark.createDataFrame([(None, at, 429, None), (None, at + datetime.timedelta(minutes=1), None, None), ("a", at, 200, "x"), ("a", None, 200, "x")], "provider string, ts timestamp, status int, message string")
    assert sorted((str(r.provider), str(r.status), r.admitted) for r in health.cooldowns(cool).collect()) == [("None", "429", True), ("None", "None", False), ("a", "200", False), ("a", "200", True)]


def test_late_rows_and_state(spark, tmp_path):
    """Rows later than the watermark (that of the batch before the last, as Spark filters) are dropped; windows end with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = datetime.datetime(2026, 1, 1)
    for minutes in ([0, 0, 0], [60, 60], [61], [1], [62, 120], [121]):
        spark.createDataFrame([("a", m, at + datetime.timedelta(minutes=m)) for m in minutes], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = health.admit_stream(stream, "k", "ts", 2, 600).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.n, r.admitted) for r in spark.table("late").collect())
    assert got == [(0, False), (0, True), (0, True), (60, True), (60, True), (61, False), (62, False), (120, True), (121, True)]
