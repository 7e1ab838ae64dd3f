"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of a few tables hashes a unit vector by Gaussian (2-stable) projections cut into cells of one width. A query
visits its own bucket and then perturbed ones in the order of their estimated success: the probability, under the
projections' distribution, that a neighbour at the expected cosine lies in the bucket; it stops when the visited
buckets' probabilities add up to ``mass``, over as many buckets as that takes at any number of rows. The candidates of
all tables are merged and their cosines computed exactly. Buckets that differ in their last two projections alone form a
region; rows and visits meet by region, so a query's vector is sent once a region with the list of the buckets it visits
there, and only rows of these buckets are candidates.

The index holds every row; only the expected cosine is fitted, on a bounded sample. The number of projections grows
with the number of rows, so that buckets keep their size. A bucket of any size is cut into blocks of ``block``
candidates and ``block`` queries, and a block gives the best few of each query: no row is made for a pair.

Of equal vectors only the ``k + 1`` with the smallest ids can be among the best ``k`` of any query (own row left out,
ties to the smaller id), so the others need not take part as candidates; equal query vectors are searched once. A
query that finds fewer than ``k + 1`` rows widens its search step by step (``WIDER``); only one that still lacks rows,
such as in a table of few rows, is compared with all candidates, in blocks.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part, nor do null ids; a row repeated with the same id and vector counts once; with fewer candidates than ``k``
all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

_PHI = np.frompyfunc(lambda z: 0.5 * (1 + erf(z / 1.4142135623730951)), 1, 1)
HITS = "qrep long, vec_id long, score double"
#: Visited regions that a task hands on at a time, each with its query's vector.
PIECE = 4_096
#: A query that finds too few rows searches again as if its neighbours were at these shares of the expected cosine.
WIDER = (0.5, 0.2)


class Index:
    """The hash functions: ``tables`` x ``size`` projections of unit vectors, cells of ``width``."""

    def __init__(self, dim: int, rows: int, expected: float, tables: int = 2, width: float = 1.5, mass: float = 0.82, bucket_rows: int = 1024, seed: int = 3):
        self.size = int(np.clip(round(np.log2(max(rows, 1) / bucket_rows) / 1.6), 4, 14))
        self.tables, self.width, self.mass, self.expected = tables, width, mass, float(np.clip(expected, 0.05, 0.98))
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(tables, self.size, dim))
        self.shift = rng.random((tables, self.size)) * width

    def place(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(projections, cells) of unit vectors, a row each."""
        f = unit @ self.planes[table].T
        return f, np.floor((f + self.shift[table]) / self.width).astype(np.int64)

    @staticmethod
    def name(cells: np.ndarray) -> np.ndarray:
        """One long for each row of cells."""
        h = np.zeros(len(cells), dtype=np.uint64)
        for k in range(cells.shape[1]):
            h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def region(self, cells: np.ndarray) -> np.ndarray:
        """One long for each row of cells, shared by the buckets that differ in the last two projections alone."""
        return self.name(cells[:, : max(1, self.size - 2)])

    def probes(self, f: np.ndarray, own: np.ndarray, table: int) -> np.ndarray:
        """The buckets that one query visits: its own first, then by falling estimated success."""
        spread, mean = (1 - self.expected**2) ** 0.5, self.expected * f
        around = np.floor((mean + self.shift[table]) / self.width).astype(np.int64)[:, None] + np.arange(-6, 7)
        low = around * self.width - self.shift[table][:, None]
        chance = (_PHI((low + self.width - mean[:, None]) / spread) - _PHI((low - mean[:, None]) / spread)).astype(float)
        order = np.argsort(-chance, axis=1, kind="stable")
        cells, chance = np.take_along_axis(around, order, 1), np.take_along_axis(chance, order, 1)
        rest = np.append(np.cumprod(chance[::-1, 0])[::-1], 1.0)  # the best that the projections from one on can add
        least = rest[0]
        while True:  # all buckets of at least this success; a lower bound until they hold the mass
            least *= 0.3
            joint, at = np.ones(1), np.zeros((1, 0), dtype=np.int8)
            for k in range(self.size):
                i, j = np.nonzero(np.multiply.outer(joint, chance[k] * rest[k + 1]) >= least)
                joint, at = joint[i] * chance[k][j], np.column_stack((at[i], j.astype(np.int8)))
            if joint.sum() >= self.mass or least < 1e-300:
                break
        order = np.argsort(-joint, kind="stable")
        at = at[order[: int(np.searchsorted(np.cumsum(joint[order]), self.mass)) + 1]]
        found = np.stack([cells[k][at[:, k]] for k in range(self.size)], axis=1)
        return np.concatenate((own[None, :], found[(found != own).any(axis=1)]))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of a double
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows; the same two vectors give the same number wherever they stand."""
    q, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (q, v))
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _best(queries: pd.DataFrame, rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` best rows of one block for each query of another."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"qrep": [], "vec_id": [], "score": []}).astype({"qrep": "int64", "vec_id": "int64", "score": "float64"})
    q, v, ids, names = _matrix(queries["vector"]), _matrix(rows["vector"]), rows["vec_id"].to_numpy(), queries["qrep"].to_numpy()
    k = min(keep, len(ids))
    found, unit = [], _unit(v)
    visited = "buckets" in queries
    if visited:
        every, of_row = np.unique(rows["bucket"].to_numpy(), return_inverse=True)
        lists = queries["buckets"].to_numpy()
    for at in range(0, len(q), 512):  # what a step holds is 512 x block numbers
        rough = _unit(q[at : at + 512]) @ unit.T
        if visited:
            open_ = np.stack([np.isin(every, b) for b in lists[at : at + 512]])
            rough[~open_[:, of_row]] = -2
        floor = np.maximum(np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9, -1.5)
        i, j = np.nonzero(rough >= floor[:, None])  # k a query, and what equals the last
        s = cosines(q[at + i], v[j])
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < k
        found.append(pd.DataFrame({"qrep": names[at + i[first]], "vec_id": ids[j[first]], "score": s[first]}))
    return pd.concat(found, ignore_index=True)


def _expected_cosine(rows: DataFrame, n: int, k: int, sample: int) -> float:
    """The median cosine of the k-th neighbour in a sample of about ``sample`` rows drawn by the hash of their ids."""
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < min(1.0, sample / max(n, 1))
    got = rows.where(share).select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()
    if len(got) <= k:
        return 0.9
    x = _unit(np.array([r["vector"] for r in sorted(got, key=lambda r: r["vec_id"])], dtype=float))
    s = x[:: max(1, len(x) // 64)] @ x.T
    return float(np.median(np.sort(s, axis=1)[:, -1 - k]))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, sample: int = 2000, block: int = 4096, vec_id: str = "vec_id", vector: str = "embedding", **parameters) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest cosine to each query, the query's own row left
    out. Both tables have an id and a vector."""

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).distinct()

    rows, asked = valid(rows), valid(queries)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    if not lengths:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    dim = lengths[0]["n"]
    few = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = cut_lineage(rows.where(F.size("vector") == dim).withColumn("_few", few).where(F.col("_few") <= k + 1).drop("_few"))
    asked = asked.where(F.size("vector") == dim)
    distinct = cut_lineage(asked.groupBy("vector").agg(F.min("vec_id").alias("qrep")))
    n = rows.count()
    expected = _expected_cosine(rows, n, k, sample)
    index = Index(dim, n, expected, **parameters)

    def put(batches):
        for batch in batches:
            unit = _unit(_matrix(batch["vector"])) if len(batch) else np.zeros((0, dim))
            for t in range(index.tables):
                cells = index.place(unit, t)[1]
                yield batch.assign(tbl=t, region=index.region(cells), bucket=index.name(cells))

    def search(few: DataFrame, m: Index) -> DataFrame:
        def visit(batches):
            for batch in batches:
                unit = _unit(_matrix(batch["vector"])) if len(batch) else np.zeros((0, dim))
                for t in range(m.tables):
                    f, own = m.place(unit, t)
                    at, where, lists = [], [], []
                    for i in range(len(batch)):
                        cells = m.probes(f[i], own[i], t)
                        regions = m.region(cells)
                        order = np.argsort(regions, kind="stable")
                        cut = np.flatnonzero(np.diff(regions[order])) + 1
                        lists += np.split(m.name(cells)[order], cut)
                        where += regions[order][np.concatenate(([0], cut))].tolist()
                        at += [i] * (len(cut) + 1)
                        if len(at) >= PIECE or i == len(batch) - 1:
                            yield batch.iloc[at].assign(tbl=t, region=where, buckets=lists)
                            at, where, lists = [], [], []

        visits = few.mapInPandas(visit, "vector array<double>, qrep long, tbl int, region long, buckets array<long>")
        return _by_blocks(stored, visits, ["tbl", "region"], k + 1, block)

    stored = rows.mapInPandas(put, "vec_id long, vector array<double>, tbl int, region long, bucket long")
    top = cut_lineage(_top(search(distinct, index), k + 1))

    def short() -> DataFrame:
        full = top.groupBy("qrep").count().where(F.col("count") >= min(k + 1, n))
        return distinct.join(full, "qrep", "left_anti").select("vector", "qrep")

    hits = top.select("qrep", "vec_id", "score")
    for share in WIDER:
        few = cut_lineage(short())
        if few.isEmpty():
            break
        wider = Index(dim, n, expected * share, **(parameters | {"mass": 0.95}))  # the same planes and buckets
        top = cut_lineage(_top(hits.unionByName(search(few, wider)), k + 1))
        hits = top.select("qrep", "vec_id", "score")
    few = cut_lineage(short())
    if not few.isEmpty():
        everything = rows.withColumn("tbl", F.lit(0)), few.withColumn("tbl", F.lit(0))
        top = _top(hits.unionByName(_by_blocks(*everything, ["tbl"], k + 1, block)), k + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), "vector").join(distinct.hint("merge"), "vector").select("query_id", "qrep").join(top.drop("rank"), "qrep").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(hits: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` distinct rows of each query, found partly before the shuffle."""
    once = hits.groupBy("qrep", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= keep)


def _by_blocks(stored: DataFrame, visits: DataFrame, keys: list[str], keep: int, block: int) -> DataFrame:
    """Compare the queries of each region with its rows, in blocks of about ``block`` of either.

    Spark takes visits for as large as the queries that they are made of, which are hundreds of times smaller, and would
    send them to all tasks through the driver. So they and the rows stand on the left of left joins, of which only the
    right side can be sent, and the numbers of blocks on the right, counted and written before."""
    ones = lambda df, r, q: df.select(*keys, F.lit(r).alias("_rows"), F.lit(q).alias("_queries"))
    cuts = ones(stored, 1, 0).union(ones(visits, 0, 1)).groupBy(*keys).agg(*[F.ceil(F.sum(c) / block).alias(c) for c in ("_rows", "_queries")])
    cuts = cut_lineage(cuts.where("_rows > 0 and _queries > 0"))  # regions that hold rows and are visited
    # Not explode(): with it Spark would make an inner join of the left one.
    across = lambda n: F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = stored.join(cuts, keys, "left").withColumn("_r", F.pmod(F.xxhash64("vec_id"), F.col("_rows"))).withColumn("_q", across("_queries")).where("_q is not null")
    asks = visits.join(cuts, keys, "left").withColumn("_q", F.pmod(F.xxhash64("qrep"), F.col("_queries"))).withColumn("_r", across("_rows")).where("_r is not null")
    by = [*keys, "_r", "_q"]
    left = asks.select(*by, "qrep", "vector", *[c for c in ("buckets",) if c in visits.columns]).groupBy(*by)
    right = rows.select(*by, "vec_id", "vector", *[c for c in ("bucket",) if c in stored.columns]).groupBy(*by)
    return left.cogroup(right).applyInPandas(lambda a, b: _best(a, b, keep), HITS)
