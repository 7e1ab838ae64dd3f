"""Admission and cool-down: keys read whole and keys cut into slices give what a fold gives."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgwatch.streaming import health, openings

AT = datetime.datetime(2026, 1, 1)


def fold_admit(rows, n, seconds):
    out, opened, used = [], {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1] or AT, r[2])):
        if t is None:
            out.append((k, t, i, False))
            continue
        if k not in opened or t - opened[k] >= datetime.timedelta(seconds=seconds):
            opened[k], used[k] = t, 0
        used[k] += 1
        out.append((k, t, i, used[k] <= n))
    return sorted(out, key=str)


def fold_cool(rows, minutes):
    out, free = [], {}
    for p, t, s, m in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")):
        ok = p not in free or t >= free[p]
        if ok and (s in (403, 429) or (m and re.search("challenge|too many|rate limit", m, re.I))):
            free[p] = t + datetime.timedelta(minutes=minutes)
        out.append((p, t, s, m, ok))
    return sorted(out, key=str)


@pytest.mark.parametrize("spread, window, n", [(2000, 60, 3), (300, 60, 5), (100_000, 60, 1), (50, 1000, 2), (2000, 0, 1)])
def test_slices_equal_the_fold(spark, spread, window, n):
    """Sparse and dense keys, slices longer and shorter than a window, ties, rows without a time, a null key."""
    draw = random.Random(spread + window)
    rows = [(draw.choice(["a", "a", "a", "b", None]), AT + datetime.timedelta(seconds=draw.randint(0, spread)), i) for i in range(1500)]
    rows += [("a", None, 9000 + i) for i in range(3)]
    log = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int")
    want = fold_admit(rows, n, window)
    for size in (70, 10_000):
        assert sorted((tuple(r) for r in health.admit(log, "k", "ts", n, window, size).collect()), key=str) == want, size


@pytest.mark.parametrize("spread", [500, 20_000])
def test_cooldown_slices_equal_the_fold(spark, spread):
    draw = random.Random(spread)
    rows = [(draw.choice(["a", "a", "b", None]), AT + datetime.timedelta(minutes=draw.randint(0, spread)), draw.choice([200, 200, 403, 429, None]), draw.choice([None, "Too Many requests", "fine"])) for _ in range(1200)]
    log = spark.createDataFrame(rows, "provider string, ts timestamp_ntz, status int, message string")
    for size in (60, 10_000):
        assert sorted((tuple(r) for r in health.cooldowns(log, 30, size).collect()), key=str) == fold_cool(rows, 30), size


def test_steps_of_a_slice():
    """Whatever the threshold within a window of the first row, the step function gives what following the openings gives."""
    draw = np.random.default_rng(4)
    for _ in range(300):
        t = np.sort(draw.integers(0, 60, draw.integers(1, 40)))
        may, window = draw.random(len(t)) < 0.6, int(draw.integers(1, 30))
        upto, out, opened = openings._steps(t, may, window)
        for tau in range(-1, int(t[0]) + window + 1):
            now, at = tau, None
            for i, (x, m) in enumerate(zip(t, may)):
                if m and x >= now:
                    now, at = int(x) + window, i
            k = int(np.searchsorted(upto, tau))
            assert (now, at) == ((out[k], opened[k]) if k < len(upto) else (tau, None))


def test_empty_and_extra_columns(spark):
    log = spark.createDataFrame([], "k string, ts timestamp, admitted_by string")
    assert health.admit(log, "k", "ts", 1, 60).count() == 0
    one = spark.createDataFrame([("a", AT, "x"), ("a", AT, "y")], "k string, ts timestamp, _tau string")
    got = health.admit(one, "k", "ts", 1, 60).orderBy("_tau").collect()
    assert [(r._tau, r.admitted) for r in got] == [("x", True), ("y", False)]
    assert health.admit(one.select("ts", "k"), "k", "ts", 1, 60).where(F.col("admitted")).count() == 1
