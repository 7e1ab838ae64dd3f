"""Operators that decide in rounds or in one pass, against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from orgwatch.operators import dedup, joins, writes


def fold_titles(rows, k):
    kept = {}
    for i, org, score, title, url in sorted(rows, key=lambda r: (-r[2], r[0])):
        mine = kept.setdefault(org, [])
        key = "".join(c for c in title.lower() if c.isalnum())
        if len(mine) < k and not any((u and u == url) or (key and q and (key in q or q in key)) for _, q, u in mine):
            mine.append((i, key, url))
    return sorted(i for m in kept.values() for i, _, _ in m)


@pytest.mark.parametrize("alphabet, longest", [("ab", 4), ("abc d-", 9), ("abcdefgh", 6)])
def test_title_rounds_equal_the_fold(spark, alphabet, longest):
    """Nested, equal, short and empty titles, shared and missing URLs, ties of scores, a null organization."""
    draw = random.Random(longest)
    rows = [
        (f"e{i:04d}", draw.choice(["o1", "o1", "o2", None]), draw.randint(1, 5), "".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest))), draw.choice([None, f"https://a.org/{draw.randint(0, 400)}"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id string, organization_id string, relevance_score int, title string, source_url string")
    for k in (3, 1000):
        want = fold_titles(rows, k)
        assert sorted(r.id for r in dedup.dedupe_titles(df, k).collect()) == want
        assert sorted(r.id for r in dedup.dedupe_titles(df, k, fold=150).collect()) == want, k


def test_titles_of_a_large_organization(spark):
    """60,000 candidates of one organization, half of them repeats: no group is gathered into one row."""
    df = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.lit("o").alias("organization_id"), (F.col("id") % 100).cast("int").alias("relevance_score"), F.concat(F.lit("report number "), F.lpad((F.col("id") % 30_000).cast("string"), 6, "0")).alias("title"), F.lit(None).cast("string").alias("source_url"))
    got = [r.title for r in dedup.dedupe_titles(df).collect()]
    assert len(got) == 10 and len(set(got)) == 10 and all(t.endswith("99") for t in got)


def test_containments(spark):
    draw = random.Random(8)
    keys = {("g", "".join(draw.choice("abc") for _ in range(draw.randint(1, 8)))) for _ in range(300)}
    df = spark.createDataFrame(sorted(keys), "_group string, _key string")
    got = sorted((r._key, r._other) for r in dedup._containments(df).collect())
    assert got == sorted((a, b) for _, a in keys for _, b in keys if a != b and (a in b or b in a))


def fold_chunks(text, most):
    done, now = [], None
    for line in text.split("\n"):
        if now is not None and len((now + "\n" + line).encode()) <= most:
            now += "\n" + line
        else:
            done, now = (done if now is None else [*done, now]), line
    return [*done, now]


def test_chunks_equal_the_fold(spark):
    draw = random.Random(3)
    texts = ["\n".join("äb€"[draw.randint(0, 2)] * draw.randint(0, 9) for _ in range(draw.randint(1, 30))) for _ in range(200)] + ["", "\n", "\n\n\n"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "i int, t string")
    got = {}
    for r in writes.chunk_lines(df, F.col("t"), 12).orderBy("i", "piece_no").collect():
        got.setdefault(r.i, []).append(r.piece)
        assert r.oversize == (len(r.piece.encode()) > 12)
    assert got == {i: fold_chunks(t, 12) for i, t in enumerate(texts)}
    long = spark.createDataFrame([("line of text\n" * 1_000_000,)], "t string")
    assert writes.chunk_lines(long, F.col("t"), 1000).select("piece_no").count() == 12_988


def test_chain_ends(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "y"), ("self", "self"), ("c5", "b"), ("one", "two"), ("one", "aaa"), (None, "c1"), ("n", None)]
    got = {r["from"]: r["to"] for r in joins.chain_ends(spark.createDataFrame(links, '`from` string, `to` string')).collect()}
    want = {f"c{i}": "b" for i in range(6)} | {f"c{i}": "c37" for i in range(6, 37)} | {"one": "aaa"}
    assert got == want
    assert joins.chain_ends(spark.createDataFrame([], '`from` string, `to` string')).count() == 0
