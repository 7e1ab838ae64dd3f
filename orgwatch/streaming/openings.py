"""Windows that open where the last one has ended: which rows open one, for keys of any size.

A row that may open a window (a *starter*) opens one if its time has reached the key's threshold, which then moves to that
time plus the window's length. Every opening depends on the one before, but only through the threshold. So a key with many
rows is cut into slices of its time order, dealt to many tasks. Each slice tells, for the thresholds with which it can be
entered (they lie within one window of its first row), the threshold that it leaves behind: a step function, found by
following each starter's next opening inside the slice. A key's slices are then chained, a few numbers each, and every
slice is read again with the threshold that it is entered with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

#: Columns that begin with two underscores are this module's own; a log has none.
NEVER = -(1 << 62)


def _micros(column: pa.Array) -> np.ndarray:
    kind = column.type
    return column.cast(pa.timestamp("us", tz=kind.tz), safe=False).cast(pa.int64()).fill_null(NEVER).to_numpy(zero_copy_only=False)


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values; null (or NaN) is a value."""
    coded = column.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _same(a: tuple, b: tuple | None) -> bool:
    return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]]]]:
    """Each batch with its stretches (from, to, whether one begins there) of rows that agree in ``by``."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in by:
            codes = _codes(batch.column(c))
            change[1:] |= codes[1:] != codes[:-1]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(batch.column(c)[0].as_py() for c in by)
        yield batch, [(a, b, a > 0 or not _same(first, last)) for a, b in zip(at, at[1:])]
        last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by)


class _Fold:
    """What a key's rows so far leave behind: the threshold, how many rows there were, and which of them opened last."""

    def __init__(self, window: int, most: int | None, tau: int = NEVER, rows: int = 0, opened: int = 0) -> None:
        self.window, self.most, self.tau, self.rows, self.opened = window, most, tau, rows, opened

    def admit(self, t: np.ndarray, starter: np.ndarray) -> np.ndarray:
        """Of the next rows, by time: the first ``most`` of each window, or, without ``most``, those that find none open."""
        out, at, k = np.zeros(len(t), dtype=bool), 0, 0
        places = np.flatnonzero(starter)
        times = t[places]
        while True:
            k = max(k, int(np.searchsorted(times, self.tau, side="left")))
            stop = int(places[k]) if k < len(places) else len(t)
            if self.most is None:
                out[at:stop] = t[at:stop] >= self.tau
            else:
                out[at:stop] = np.arange(at, stop) + self.rows - self.opened < self.most
            if stop == len(t):
                break
            self.tau, self.opened = int(t[stop]) + self.window, self.rows + stop
            out[stop] = True if self.most is None else self.most > 0
            at, k = stop + 1, k + 1
        self.rows += len(t)
        return out


def _folded(rows: DataFrame, by: list[str], ts: str, starter: str, window: int, most: int | None, entered: bool, out: T.StructType) -> DataFrame:
    """``rows``, sorted within their tasks, with ``admitted``; a row without a time never passes and opens nothing."""
    extra = {starter, *(("__tau", "__rows", "__opened", "__slice") if entered else ())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch, stretches in _runs(batches, by):
            t, may, admitted = _micros(batch.column(ts)), batch.column(starter).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, dtype=bool)
            for a, b, new in stretches:
                if new:
                    state = _Fold(window, most, *(int(batch.column(c)[a].as_py()) for c in ("__tau", "__rows", "__opened"))) if entered else _Fold(window, most)
                a = a + int(np.searchsorted(t[a:b], NEVER, side="right"))  # rows without a time come first
                admitted[a:b] = state.admit(t[a:b], may[a:b])
            kept = [i for i, name in enumerate(batch.schema.names) if name not in extra]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(admitted)], names=[*[batch.schema.names[i] for i in kept], "admitted"])

    return rows.mapInArrow(run, out)


def _steps(t: np.ndarray, starter: np.ndarray, window: int) -> tuple[list[int], list[int], list[int]]:
    """The step function of a slice: entered with a threshold up to ``upto[i]``, it leaves ``out[i]`` behind, having opened
    last at its row ``opened[i]``. A threshold beyond all of them opens nothing."""
    places = np.flatnonzero(starter)
    times = t[places]
    n = len(times)
    if not n:
        return [], [], []
    after, last = np.searchsorted(times, times + window, side="left"), np.arange(n)
    after = np.maximum(after, np.arange(n) + 1)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    entries = min(n, int(np.searchsorted(times, t[0] + window, side="left")) + 1)
    ends = [i for i in range(entries) if i + 1 == entries or last[i + 1] != last[i]]
    return [int(times[i]) for i in ends], [int(times[last[i]]) + window for i in ends], [int(places[last[i]]) for i in ends]


def admit_rows(log: DataFrame, key: str, ts: str, order: list[str], starter: str, window_us: int, most: int | None, rows_a_slice: int = 500_000) -> DataFrame:
    """``log`` without ``starter`` (a boolean column: may the row open a window) and with ``admitted``: the first ``most`` rows of
    each window, from its opening on; or, where ``most`` is none, every row that finds no window open. Rows are taken by ``ts``
    and then ``order``; null (or NaN) keys are one key.

    Keys of up to ``rows_a_slice`` rows are read in order by one task each, larger ones in slices of about that many.
    """
    fields = T.StructType([*[f for f in log.schema.fields if f.name != starter], T.StructField("admitted", T.BooleanType())])
    whole = lambda df: _folded(df.repartition(key).sortWithinPartitions(key, ts, *order), [key], ts, starter, window_us, most, False, fields)
    large = log.groupBy(F.col(key).alias("__large")).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_a_slice)
    sizes = large.agg(F.sum("__n")).first()[0]
    if not sizes:
        return whole(log)
    large = written(large.select("__large"))
    same = F.col(key).eqNullSafe(F.col("__large"))
    rows = log.join(large, same, "left_semi")
    untimed = rows.where(F.col(ts).isNull()).drop(starter).withColumn("admitted", F.lit(False))
    dealt = rows.where(F.col(ts).isNotNull()).repartitionByRange(max(2, -(-sizes // rows_a_slice)), key, ts, *order)
    dealt = written(dealt.withColumn("__slice", F.spark_partition_id()))
    sliced = lambda df: df.repartition("__slice").sortWithinPartitions("__slice", key, ts, *order)
    key_field = T.StructField(key, log.schema[key].dataType)
    numbers = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("upto", "out", "opened")]
    told = sliced(dealt.select("__slice", key, ts, *[c for c in order if c != ts], starter)).mapInArrow(_summaries(key, ts, starter, window_us), T.StructType([key_field, T.StructField("__slice", T.IntegerType()), T.StructField("n", T.LongType()), *numbers]))
    begin = T.StructType([key_field, *[T.StructField(c, T.LongType()) for c in ("__slice", "__tau", "__rows", "__opened")]])
    entered = told.repartition(key).sortWithinPartitions(key, "__slice").mapInArrow(_chained(key), begin)
    entered = written(entered.withColumnsRenamed({key: "__key", "__slice": "__at"}))
    joined = dealt.join(entered, (F.col("__slice") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key"))).drop("__at", "__key")
    out = _folded(sliced(joined), ["__slice", key], ts, starter, window_us, most, True, fields)
    return whole(log.join(large, same, "left_anti")).unionByName(out).unionByName(untimed)


def _summaries(key: str, ts: str, starter: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []

        def told() -> pa.RecordBatch:
            head, at, times, marks = open_
            t, may = np.concatenate(times), np.concatenate(marks)
            steps = _steps(t, may, window)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in steps]
            return pa.RecordBatch.from_arrays([head, pa.array([at], pa.int32()), pa.array([len(t)], pa.int64()), *lists], names=[key, "__slice", "n", "upto", "out", "opened"])

        for batch, stretches in _runs(batches, ["__slice", key]):
            t, may = _micros(batch.column(ts)), batch.column(starter).to_numpy(zero_copy_only=False)
            for a, b, new in stretches:
                if new:
                    if open_:
                        yield told()
                    open_ = [batch.column(key).slice(a, 1), batch.column("__slice")[a].as_py(), [], []]
                open_[2].append(t[a:b])
                open_[3].append(may[a:b])
        if open_:
            yield told()

    return run


def _chained(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tau, rows, opened = NEVER, 0, 0
        for batch, stretches in _runs(batches, [key]):
            found = []
            for a, b, new in stretches:
                if new:
                    tau, rows, opened = NEVER, 0, 0
                for r in batch.slice(a, b - a).drop_columns([key]).to_pylist():
                    found.append((r["__slice"], tau, rows, opened))
                    i = int(np.searchsorted(r["upto"], tau, side="left"))
                    if i < len(r["upto"]):
                        tau, opened = r["out"][i], rows + r["opened"][i]
                    rows += r["n"]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "__slice", "__tau", "__rows", "__opened"])

    return run
