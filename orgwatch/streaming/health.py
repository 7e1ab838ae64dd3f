"""Classes and next times of fetches, the state of sources, admission in fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import written
from .openings import admit_rows


def health_class(status: Column, error: Column) -> Column:
    """(health, retry_class) of a fetch."""
    pair = lambda h, r: F.struct(F.lit(h).alias("health"), F.lit(r).alias("retry_class"))
    return (
        F.when(status.isin(401, 403), pair("blocked", "manual")).when(status.isin(404, 410), pair("missing", "reprobe")).when(status == 429, pair("rate_limited", "backoff"))
        .when(error.isin("ETIMEDOUT", "ABORT_ERR"), pair("timeout", "retry")).otherwise(pair("failed", "retry"))
    )


def next_times(health: Column, ts: Column) -> Column:
    """(next_check_at, next_retry_at): never for a blocked source, in two hours, seven days or an hour for others."""
    wait = F.when(health == "rate_limited", F.make_interval(hours=F.lit(2))).when(health == "missing", F.make_interval(days=F.lit(7))).otherwise(F.make_interval(hours=F.lit(1)))
    blocked = health == "blocked"
    return F.struct(
        F.when(blocked, F.lit("9999-12-31").cast(ts_type())).otherwise(ts + wait).alias("next_check_at"), F.when(blocked, F.lit(None).cast(ts_type())).otherwise(ts + wait).alias("next_retry_at")
    )


def ts_type() -> str:
    return "timestamp_ntz"


def source_state(log: DataFrame) -> DataFrame:
    """The state of each source by its latest fetch (ties: the largest fetch id); every record counts as a failure."""
    last = F.max_by(F.struct("status", "error_code", "ts"), F.struct("ts", "fetch_id"))
    state = log.groupBy("source_id").agg(last.alias("l"), F.count("*").alias("failure_count"), F.count_if(F.col("status").between(200, 299)).alias("success_count"))
    state = state.withColumn("h", health_class(F.col("l.status"), F.col("l.error_code"))).withColumn("n", next_times(F.col("h.health"), F.col("l.ts").cast(ts_type())))
    return state.select("source_id", F.col("l.status").alias("status"), F.col("l.ts").alias("last_checked_at"), "h.health", "h.retry_class", "failure_count", "success_count", "n.next_check_at", "n.next_retry_at")


def admit(log: DataFrame, key: str, ts: str, n: int, window_s: int, rows_a_slice: int = 500_000) -> DataFrame:
    """Each row with ``admitted``: a window opens at a key's first row after the last window's end, and the first ``n`` rows
    of a window pass. Where windows open depends on the data, so a key's rows are read in order, those of a very large key in
    slices (see ``openings``). A row without a time never passes; null keys are one key."""
    rest = [c for c in log.columns if c not in (key, ts)]
    return admit_rows(log.withColumn("__starter", F.lit(True)), key, ts, rest, "__starter", window_s * 1_000_000, n, rows_a_slice)


class _Admission(StatefulProcessor):
    def __init__(self, ts: str, n: int, window_s: int):
        self.ts, self.n, self.window_s = ts, n, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start timestamp, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, used = self.state.get() if self.state.exists() else (None, 0)
        for batch in rows:
            batch = batch.sort_values(self.ts, kind="stable")
            out = []
            for t in batch[self.ts]:
                if start is None or (t - pd.Timestamp(start)).total_seconds() >= self.window_s:
                    start, used = t, 0
                used += 1
                out.append(used <= self.n)
            yield batch.assign(admitted=out)
        if start is not None:
            self.state.update((pd.Timestamp(start).to_pydatetime(), used))
            for old in list(self.handle.listTimers()):  # of a window that is over
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(int((pd.Timestamp(start).timestamp() + self.window_s) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the end of a window: no row of it can come any more."""
        if self.state.exists():
            start = pd.Timestamp(self.state.get()[0]).timestamp()
            if (start + self.window_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(log: DataFrame, key: str, ts: str, n: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """``admit`` over a stream in event time. Rows later than the watermark are dropped; a key's state is its open window and
    goes when the watermark passes its end. Rows of one batch are taken in order of time, batches as they come: a row that
    comes after later rows counts in the window that is open."""
    fields = T.StructType([*log.schema.fields, T.StructField("admitted", T.BooleanType())])
    return log.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(_Admission(ts, n, window_s), fields, "Append", "EventTime")


def source_state_stream(log: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A stream that keeps a row for each source under ``path`` (see ``read_source_state``): its latest fetch and its counts.

    Sources lie in buckets by a hash. A batch reads the buckets of its own sources and writes them anew under its number, so
    what is written follows the batch, not the state; a manifest of each batch tells which number each bucket has. Batch n
    builds on manifest n - 1, so a batch that is run again gives the same; what neither of the last two manifests names is
    removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, F.max(F.struct("ts", "fetch_id", "status", "error_code")).alias("last")
        bucket = F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int").alias("bucket")
        counts = batch.groupBy("source_id").agg(last, F.count("*").alias("failure_count"), F.count_if(F.col("status").between(200, 299)).alias("success_count"))
        counts = written(counts.select("*", bucket))
        touched = [r[0] for r in counts.select("bucket").distinct().collect()]
        before = _manifest(spark, path, number - 1) if number > 0 else {}
        old = [f"{path}/data/version={before[k]}/bucket={k}" for k in touched if k in before]
        if old:
            counts = counts.unionByName(spark.read.option("basePath", f"{path}/data").parquet(*old).select(*counts.columns))
        if touched:
            sums = [F.sum(c).alias(c) for c in ("failure_count", "success_count")]
            counts.groupBy("bucket", "source_id").agg(F.max("last").alias("last"), *sums).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        now = before | dict.fromkeys(touched, number)
        rows = spark.createDataFrame([(number, k, v) for k, v in now.items()], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{number}")
        earlier = _manifest(spark, path, number - 2) if number > 1 else {}
        for k, v in earlier.items():
            if before.get(k) != v:  # the batch before has written the bucket anew; a repeat of this one needs no more than that
                _remove(spark, f"{path}/data/version={v}/bucket={k}")
        _remove(spark, f"{path}/manifest/v{number - 2}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


MANIFEST = "number long, bucket int, version long"


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Bucket: the number under which it lies, as batch ``number`` left it; none where that manifest is gone."""
    try:
        return {r["bucket"]: r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{number}").collect()}
    except AnalysisException:
        return {}


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_source_state(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, last, failure_count, success_count) as the latest batch left it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    now = _manifest(spark, path, max(int(f.getPath().getName()[1:]) for f in found))
    folders = [f"{path}/data/version={v}/bucket={k}" for k, v in sorted(now.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).select("source_id", "last", "failure_count", "success_count")


def changed_pages(fetches: DataFrame, previous: DataFrame) -> DataFrame:
    """Fetches with ``outcome``: failed, unchanged (304 or the same content) or changed."""
    known = previous.select("source_id", F.col("content_hash").alias("_old"))
    joined = fetches.withColumn("content_hash", F.sha2(F.coalesce("body", F.lit("")), 256)).join(known, "source_id", "left")
    same = (F.col("status") == 304) | F.coalesce(F.col("content_hash") == F.col("_old"), F.lit(False))
    return joined.withColumn("outcome", F.when(~F.col("status").between(200, 399), "failed").when(same, "unchanged").otherwise("changed")).drop("_old")


def cycle_stats(outcomes: DataFrame) -> DataFrame:
    c = F.col("outcome")
    return outcomes.agg(F.count("*").alias("checked"), F.count_if(c == "changed").alias("changed"), F.count_if(c == "failed").alias("failed"))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def cooldowns(log: DataFrame, minutes: int = 30, rows_a_slice: int = 500_000) -> DataFrame:
    """Each attempt of the log (provider, ts, status, message) with ``admitted``: after an admitted attempt that was answered 403
    or 429, or with a challenge, the provider is left alone for ``minutes``. Which attempts are admitted depends on those
    before. An attempt without a time is not admitted; null providers are one provider."""
    refused = F.coalesce(F.col("status").isin(403, 429), F.lit(False)) | F.coalesce(F.col("message").rlike("(?i)challenge|too many|rate limit"), F.lit(False))
    rest = ["status", "message", *[c for c in log.columns if c not in ("provider", "ts", "status", "message")]]
    return admit_rows(log.withColumn("__starter", refused), "provider", "ts", rest, "__starter", minutes * 60_000_000, None, rows_a_slice)
