"""N-gram Jaccard self-join of documents with Bayesian pruning of candidates.

Documents with the same set of word 5-grams form one node, so copies take part once. Nodes that agree on a band of
MinHash values are candidates. Inside a bucket that fits in a block they are compared by 128 short MinHash values, pairs whose
posterior is below the tolerance drop out, and a star of edges is told for each set of nodes that the others connect; a
larger bucket gives one star (to its least node). So a pair that may be similar lies in one component of the stars, and
documents that only share a template, which meet in buckets by chance, do not grow into one component. Nodes of a
component are compared in blocks: MinHash values are compared a few at a time, a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a tolerance, and what is left is verified exactly on the 5-gram sets. No
row is made for a pair: a block gives each node its number of links and the least node it is connected to.

A component that does not fit in one block is not compared text by text. One block of it gives a pivot, the 5-grams that
at least half of its nodes have, and every node is told by its difference from the pivot: |S ^ R| of two sets is
|T ^ U| of their differences T and U, so the differences decide as exactly as the sets and are small where texts are near
copies. Two nodes whose differences both are at most (1 - threshold) / (1 + threshold) of their sets are linked for
certain, so all links among those *tight* nodes are counted by one sum. Only the others, the *loose* nodes, are compared
with all nodes of their component, block by block, and a block pair is sent sketches and differences, never texts. The
work is quadratic in the loose nodes alone. Blocks are bounded by rows and by 5-grams.

At 40 bands of 7 values, a pair at similarity 0.8 shares no band with probability 1e-4, at 0.9 with 1e-11.

Defined cases: a text of one to four words counts as one n-gram; a null, empty or blank text has none, links to
nothing and is a class of its own; repeated rows are copies of each other; a null ``doc_id`` is carried and comes after
all others; an id with several texts counts once for each; an empty table gives an empty result; extra columns are
ignored by ``similar_documents`` and kept by ``drop_similar``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lineage
from .components import components

_WORD = re.compile(WORD)
BANDS, ROWS, SKETCH, BRIEF = 40, 7, 64, 128
STAGES = (16, 32, 64)
ROWS_A_GROUP = 50_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word n-grams; empty for a text without words."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], dtype=np.uint64)
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=12).digest()


@lru_cache(maxsize=4)
def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return rng.integers(1, top, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, top, count, dtype=np.uint64)


def minhash(s: np.ndarray, count: int, seed: int, step: int = 2048) -> np.ndarray:
    """``count`` MinHash values (32 bits) of a non-empty set."""
    a, b = _multipliers(count, seed)
    best = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), step):
        np.minimum(best, (a[:, None] * s[None, at : at + step] + b[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def bands_of(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The buckets of a set, one for each band, and the last byte of ``BRIEF`` of its MinHash values."""
    values = minhash(s, BANDS * ROWS, 1)
    buckets = [xxhash.xxh3_64_intdigest(v.tobytes(), seed=i) for i, v in enumerate(values.reshape(BANDS, ROWS))]
    return np.array(buckets, dtype=np.uint64).view(np.int64), values[: 2 * BRIEF : 2].astype(np.uint8).tobytes()


@lru_cache(maxsize=64)
def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among ``seen`` at which similarity >= threshold still has a posterior of ``tolerance``,
    under a uniform prior: the posterior is then a beta distribution."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    tail = grid >= threshold
    for m in range(seen + 1):
        log = m * np.log(grid) + (seen - m) * np.log1p(-grid)
        density = np.exp(log - log.max())
        if density[tail].sum() / density.sum() >= tolerance:
            return m
    return seen


def _survivors(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of rows may reach the threshold: by size, then by more and more MinHash values."""
    small, large = np.minimum(nx[:, None], ny[None, :]), np.maximum(nx[:, None], ny[None, :])
    alive = small >= threshold * large - 1e-9
    equal = np.zeros(alive.shape, dtype=np.int16)
    seen = 0
    for stage in STAGES:
        if alive.mean() > 0.05:
            for k in range(seen, stage):
                equal += x[:, k, None] == y[None, :, k]
        else:
            i, j = np.nonzero(alive)
            equal[i, j] += (x[i, seen:stage] == y[j, seen:stage]).sum(axis=1).astype(np.int16)
        seen = stage
        alive &= equal >= least_matches(seen, threshold, tolerance)
        if not alive.any():
            break
    return alive


def _common(left: list[np.ndarray], right: list[np.ndarray] | None, i: np.ndarray, j: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many elements left[i] and right[j] share, for each of the given pairs; ``right`` None: within ``left``."""
    other = left if right is None else right
    if len(i) <= 4 * (len(left) + len(other)):
        return np.array([len(np.intersect1d(left[a], other[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    every = [*left, *([] if right is None else right)]
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, column, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = times > 1  # an element of one set alone is in no pair
    rows, column = rows[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(other)), dtype=np.float32)
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(every), width), dtype=np.float32)
        dense[rows[lo:hi], column[lo:hi] - start] = 1
        out += dense[: len(left)] @ (dense if right is None else dense[len(left) :]).T
    return np.rint(out[i, j]).astype(np.int64)


@dataclass
class Side:
    """Nodes as a block holds them: the sizes of their sets, their sketches, and their differences from a pivot (the
    sets themselves where there is none)."""

    size: np.ndarray
    sketch: np.ndarray
    delta: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.size)


def linked(left: Side, right: Side | None, threshold: float, tolerance: float) -> np.ndarray:
    """The matrix of pairs (left, right) with Jaccard similarity >= threshold; ``right`` None: within ``left``."""
    other = left if right is None else right
    alive = _survivors(left.sketch, other.sketch, left.size, other.size, threshold, tolerance)
    if right is None:
        alive &= np.tri(len(left), k=-1, dtype=bool)
    i, j = np.nonzero(alive)
    both = _common(left.delta, None if right is None else right.delta, i, j)
    apart = np.array([len(d) for d in left.delta])[i] + np.array([len(d) for d in other.delta])[j] - 2 * both
    exact = Fraction(str(threshold))
    good = apart * (exact.denominator + exact.numerator) <= (left.size[i] + other.size[j]) * (exact.denominator - exact.numerator)
    out = np.zeros(alive.shape, dtype=bool)
    out[i[good], j[good]] = True
    return out | out.T if right is None else out


def _least_connected(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the least row of its component."""
    n = len(adjacent)
    label = np.arange(n, dtype=np.int32)
    while True:
        near = np.where(adjacent, label[None, :], np.int32(n)).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = "key binary, links long, hub binary"
DELTAS = "key binary, root binary, copies long, size long, n_delta long, delta binary, sketch binary"


def _linked_rows(keys: list[bytes], copies: np.ndarray, m: np.ndarray) -> list[tuple[bytes, int, bytes]]:
    links, hub = m @ copies, _least_connected(m)
    return [(keys[i], int(links[i]), keys[hub[i]]) for i in np.flatnonzero(links > 0)]


def _plausible(threshold: float, tolerance: float):
    """Edges that join, inside each bucket, the nodes that pairs of a plausible similarity connect: a pair drops out where its
    posterior probability of reaching the threshold is below the tolerance. Of each set of nodes so connected a star is told."""
    least = least_matches(BRIEF, threshold, tolerance)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bucket", "key"])
        keys, brief = group["key"].to_numpy(), np.frombuffer(b"".join(group["brief"]), dtype=np.uint8).reshape(len(group), BRIEF)
        _, at, size = np.unique(group["bucket"].to_numpy(), return_index=True, return_counts=True)
        twos = at[size == 2]
        good = twos[(brief[twos] == brief[twos + 1]).sum(axis=1) >= least]
        a, b = list(keys[good + 1]), list(keys[good])
        for start, n in zip(at[size > 2], size[size > 2]):
            rows = brief[start : start + n]
            equal = np.stack([(rows == r).sum(axis=1) for r in rows])
            hub = _least_connected(equal >= least)
            for i in np.flatnonzero(hub != np.arange(n)):
                a.append(keys[start + i])
                b.append(keys[start + hub[i]])
        return pd.DataFrame({"a": a, "b": b})

    return run


def _as_frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _compare_texts(threshold: float, tolerance: float, n: int):
    """All links inside whole components that fit in a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, int, bytes]] = []
        for _, part in group.groupby("root", sort=True):
            part = part.sort_values("key")
            sets = [shingles(t, n) for t in part["text"]]
            side = Side(np.array([len(s) for s in sets]), np.stack([minhash(s, SKETCH, 2) for s in sets]), sets)
            out += _linked_rows(list(part["key"]), part["copies"].to_numpy(), linked(side, None, threshold, tolerance))
        return _as_frame(out, LINKS)

    return run


def _pivot(n: int):
    """The n-grams that at least half of a component's first block have."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, times = np.unique(np.concatenate([shingles(t, n) for t in group["text"]]), return_counts=True)
        return pd.DataFrame({"root": [group["root"].iloc[0]], "pivot": [values[2 * times >= len(group)].tobytes()]})

    return run


def _differences(n: int):
    def run(group: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivot = np.frombuffer(pivots["pivot"].iloc[0], dtype=np.uint64)
        out = []
        for key, root, copies, text in zip(group["key"], group["root"], group["copies"], group["text"]):
            s = shingles(text, n)
            delta = np.setxor1d(s, pivot, assume_unique=True)
            out.append((key, root, copies, len(s), len(delta), delta.tobytes(), minhash(s, SKETCH, 2).tobytes()))
        return _as_frame(out, DELTAS)

    return run


def _compare_differences(threshold: float, tolerance: float):
    """All links between two blocks of one component."""

    def side(part: pd.DataFrame) -> Side:
        sketch = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint32).reshape(len(part), SKETCH)
        return Side(part["size"].to_numpy(), sketch, [np.frombuffer(d, dtype=np.uint64) for d in part["delta"]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        low, high = int(group["_lo"].iloc[0]), int(group["_hi"].iloc[0])
        if low == high:
            m = linked(side(group), None, threshold, tolerance)
        else:
            right = (group["_block"] == high).to_numpy()
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            m = np.zeros((len(group), len(group)), dtype=bool)
            if len(a) and len(b):
                m[np.ix_(a, b)] = linked(side(group.iloc[a]), side(group.iloc[b]), threshold, tolerance)
                m |= m.T
        return _as_frame(_linked_rows(list(group["key"]), group["copies"].to_numpy(), m), LINKS)

    return run


def _large_components(texts: DataFrame, threshold: float, tolerance: float, n: int, block: int, block_grams: int) -> DataFrame:
    """The links (LINKS) inside components of several blocks. ``texts``: key, root, copies, text, _block, _blocks."""
    pivots = texts.where("_block = 0").select("root", "text").groupBy("root").applyInPandas(_pivot(n), "root binary, pivot binary")
    # Every block of the component gets the pivot; where blocks are few and the first has no row, the pivot is empty.
    spread = texts.select("root", "_block").distinct().join(pivots, "root", "left")
    spread = spread.select(F.col("root").alias("_root"), F.col("_block").alias("_at"), F.coalesce("pivot", F.lit(b"")).alias("pivot"))
    deltas = texts.select("key", "root", "copies", "text", "_block").groupBy("root", "_block").cogroup(spread.groupBy("_root", "_at"))
    exact = Fraction(str(threshold))
    near = F.col("n_delta") * (exact.denominator + exact.numerator) <= F.col("size") * (exact.denominator - exact.numerator)
    rows = cut_lineage(deltas.applyInPandas(_differences(n), DELTAS).withColumn("_tight", near))
    tight = rows.where("_tight").groupBy("root").agg(F.sum("copies").alias("_all"), F.min("key").alias("hub"))
    certain = rows.where("_tight").join(tight, "root").select("key", (F.col("_all") - F.col("copies")).alias("links"), "hub").where("links > 0")

    part = lambda side: F.coalesce(F.ceil(F.greatest(F.count(F.when(side, 1)) / (4 * block), F.sum(F.when(side, F.col("n_delta"))) / block_grams)), F.lit(0))
    cuts = rows.groupBy("root").agg(part(~F.col("_tight")).alias("_nl"), part(F.col("_tight")).alias("_nt")).where("_nl > 0")
    placed = rows.join(cuts, "root")
    own = F.when(F.col("_tight"), F.col("_nl") + F.pmod(F.xxhash64("key"), F.col("_nt"))).otherwise(F.pmod(F.xxhash64("key"), F.col("_nl")))
    placed = placed.withColumn("_block", own)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    placed = placed.withColumn("_other", F.explode(F.when(F.col("_tight"), upto(F.col("_nl"))).otherwise(upto(F.col("_nl") + F.col("_nt")))))
    placed = placed.withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other"))
    pairs = placed.select("root", "_lo", "_hi", "_block", "key", "copies", "size", "delta", "sketch").groupBy("root", "_lo", "_hi")
    return certain.unionByName(pairs.applyInPandas(_compare_differences(threshold, tolerance), LINKS))


def _row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell rows of another id or text apart."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("_h1"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("_h2")]


def _classes(docs: DataFrame, text: str, doc_id: str, threshold: float, n: int, tolerance: float, block: int, block_grams: int) -> DataFrame:
    """``doc_id, _h1, _h2, class_id, n_links, kept`` for each row."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *_row_key("doc_id", "text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = []
            for t in batch["text"]:
                s = shingles(t, n)
                signs.append((set_key(s), len(s), *bands_of(s)) if len(s) else (None, 0, None, None))
            out = pd.DataFrame(signs, columns=["key", "grams", "bands", "brief"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "_h1": batch["_h1"], "_h2": batch["_h2"], **out})

    signed = cut_lineage(base.mapInPandas(sign, "doc_id long, _h1 long, _h2 long, key binary, grams long, bands array<long>, brief binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2")).alias("first")
    nodes = signed.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), first, *[F.first(c).alias(c) for c in ("grams", "bands", "brief")])
    nodes = cut_lineage(nodes)
    placed = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("_n")).where("_n > 1")
    met = cut_lineage(placed.join(shared, "bucket"))
    # Nodes of a bucket that fits in a block are joined where they may be similar; those of a larger one by a star to its least.
    told = met.where(F.col("_n") <= block).select("bucket", "key").join(nodes.select("key", "brief"), "key")
    dealt = told.withColumn("_group", F.pmod(F.xxhash64("bucket"), F.lit(max(8, -(-met.count() // ROWS_A_GROUP)))))
    stars = dealt.groupBy("_group").applyInPandas(_plausible(threshold, tolerance), "a binary, b binary")
    stars = stars.unionByName(met.where((F.col("_n") > block) & (F.col("key") != F.col("hub"))).select(F.col("key").alias("a"), F.col("hub").alias("b")))
    near = components(stars).withColumnRenamed("node", "key").join(nodes.drop("bands", "brief"), "key")
    near = cut_lineage(near.select("key", "root", "copies", "grams", "first._h1", "first._h2"))

    sizes = near.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("grams") / block_grams)).alias("_blocks"))
    most, rows, grams = near.join(sizes, "root").agg(F.max("_blocks"), F.count("*"), F.sum("grams")).first()
    groups = max(8, -(-rows // block), -(-(grams or 0) // block_grams))
    # Map-side combined, so that rows repeated with their id do not meet; texts move once, and those of candidates are kept.
    once = base.where("text is not null").groupBy("_h1", "_h2").agg(F.first("text").alias("text"))
    texts = cut_lineage(near.join(sizes, "root").drop("grams").join(once, ["_h1", "_h2"]).drop("_h1", "_h2"))
    small = texts.where("_blocks = 1").withColumn("_group", F.pmod(F.xxhash64("root"), F.lit(groups)))
    found = small.select("_group", "key", "root", "copies", "text").groupBy("_group").applyInPandas(_compare_texts(threshold, tolerance, n), LINKS)
    if (most or 0) > 1:
        large = texts.where("_blocks > 1").withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")))
        found = found.unionByName(_large_components(large, threshold, tolerance, n, block, block_grams))
    found = cut_lineage(found)

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "key")
    known = nodes.select("key", "copies", "first").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root").select("key", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = signed.select("doc_id", "_h1", "_h2", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    return joined.select(
        "doc_id", "_h1", "_h2", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | ((F.col("_h1") == F.col("least._h1")) & (F.col("_h2") == F.col("least._h2")))).alias("kept"),
    )


def similar_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 256, block_grams: int = 300_000
) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` for each row: the least id among all documents connected to it by links,
    the number of other rows at Jaccard similarity >= ``threshold`` to it (copies count each), and whether its id and
    text are those of its class that stay (a row repeated with its id says so each time)."""
    return _classes(docs, text, doc_id, threshold, n, tolerance, block, block_grams).drop("_h1", "_h2")


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 256, block_grams: int = 300_000) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (null last), of equal ids the one with the least
    hash. It decides by row, not by id: different texts under one id are each kept or dropped for themselves."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")  # so that no name of a column clashes with ours
    gone = _classes(docs, text, doc_id, threshold, n, tolerance, block, block_grams).where("not kept").select("_h1", "_h2").distinct()
    blank = F.when(F.coalesce(F.col(text).rlike(WORD), F.lit(False)), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    keyed = docs.select(own, F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), blank.alias("_blank"))
    left = keyed.select("_doc", "_blank", *_row_key("_id", "_text")).join(gone, ["_h1", "_h2"], "left_anti")
    # Of rows repeated with their id one stays; texts without words are classes of their own.
    once = left.groupBy("_h1", "_h2", "_blank").agg(F.first("_doc").alias("_doc"))
    return once.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
