"""Shards of near equal bytes by the minimax partition of a line of atomic groups.

Equal texts form a group, which no cut parts. Groups stand in a line by the 64-bit hash of their text, so a document's
shard follows from its own hash and the cut points alone: documents are never joined with groups, and a group of any
number of copies is summed before the shuffle. (Two texts of one hash form one group.)

The smallest capacity for which the line fits into the shards is found by binary search, and each capacity is checked
greedily: fill a shard up to the capacity, then begin the next one. A check asks 40 times for the last group that ends at
or before some byte, on a line of billions of groups. The driver therefore holds a bounded number of group ends (``cells``)
and bounds the answer between two of them; a capacity is told feasible or not by the two bounds, and where they disagree,
the few gaps that were asked for are subdivided by one filtered scan. The rounds are logarithmic in the groups and the
result is exact. Where the line is cut at that capacity, every cut goes to the known end nearest to an even share of
what is left, as long as the rest still fits, so that the last shards are not left empty.

A group larger than an even share of what is left decides the capacity whatever the cuts; such *giants* (fewer than the
shards) stand last in the line, each in a shard of its own, and the others are partitioned over the other shards.

Defined cases: a null text has no bytes and is of one group with the empty text; an empty table gives an empty result;
repeated rows, null ids and extra columns change nothing; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh
from .offsets import running_start


class Line:
    """What is known of the ends of the groups: ``pos`` and ``end`` of some of them, in order, the first (-1, 0) and the last
    always. Between two known ones lie ``pos[i+1] - pos[i] - 1`` groups whose ends are not known."""

    def __init__(self, pos: np.ndarray, end: np.ndarray) -> None:
        self.pos, self.end = pos, end

    def last_end(self, upto: int) -> tuple[int, int, int]:
        """Bounds of the largest end that is at most ``upto``, and the last known end up to it, by its index."""
        i = int(np.searchsorted(self.end, upto, side="right")) - 1
        known = int(self.end[i])
        if i + 1 == len(self.end) or self.pos[i + 1] == self.pos[i] + 1:
            return known, known, i
        return known, min(upto, int(self.end[i + 1]) - 1), i

    def fill(self, capacity: int, shards: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Greedy filling by the lower and by the upper bounds: the end that each shard reaches, and the known end before it."""
        paths = []
        for side in (0, 1):
            at, path = 0, []
            for _ in range(shards):
                *bounds, i = self.last_end(at + capacity)
                at = bounds[side]
                path.append((at, i))
            paths.append(path)
        return paths[0], paths[1]

    def hidden(self, no: int, yes: int, shards: int) -> set[int]:
        """The gaps in which a shard of a capacity above ``no`` and up to ``yes`` may stop."""
        low, high = self.fill(no + 1, shards)[0], self.fill(yes, shards)[1]
        gaps = np.diff(self.pos) > 1
        return {int(i) for (_, a), (_, b) in zip(low, high) for i in a + np.flatnonzero(gaps[a : b + 1])}

    def search(self, shards: int, no: int, yes: int) -> tuple[int, int]:
        """The largest capacity known to be too small and the smallest known to do."""
        total, low, high = int(self.end[-1]), no, yes
        while low + 1 < high:  # the smallest that does for certain
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards)[0][-1][0] >= total else (middle, high)
        yes, low = high, no
        while low + 1 < high:  # the largest that cannot do
            middle = (low + high) // 2
            low, high = (low, middle) if self.fill(middle, shards)[1][-1][0] >= total else (middle, high)
        return low, yes

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """The ends (their positions) at which all shards but the last stop."""
        total, back = int(self.end[-1]), [len(self.end) - 1]
        for _ in range(shards - 1):  # where a shard may stop at the earliest, so that the rest still fits
            back.append(int(np.searchsorted(self.end, self.end[back[-1]] - capacity, side="left")))
        found, at = [], 0
        for left in range(shards, 1, -1):
            here = int(self.end[at])
            even = here + -(-(total - here) // left)
            i = int(np.searchsorted(self.end, even, side="left"))
            if i == len(self.end) or (i and even - self.end[i - 1] < self.end[i] - even):
                i -= 1
            latest = int(np.searchsorted(self.end, here + capacity, side="right")) - 1
            at = max(min(max(i, back[left - 1]), latest), at)
            found.append(int(self.pos[at]))
        return found


def _refined(line: Line, groups: DataFrame, asked: set[int], cells: int) -> Line:
    """``line`` with more ends known in the gaps ``asked``: one scan of the groups in them, ``cells`` rows to the driver."""
    runs: list[tuple[int, int]] = []
    for i in sorted(asked):
        a, b = int(line.pos[i]) + 1, int(line.pos[i + 1])
        runs = [*runs[:-1], (runs[-1][0], b)] if runs and runs[-1][1] + 1 >= a else [*runs, (a, b)]
    narrowest = min(int(line.pos[i + 1] - line.pos[i]) for i in asked)
    step = max(1, min(sum(b - a + 1 for a, b in runs) // cells, narrowest // 2))  # every gap that was asked for is divided
    inside = F.lit(False)
    for a, b in runs:
        inside = inside | F.col("pos").between(a, b)
    new = groups.where(inside).groupBy(F.floor(F.col("pos") / step)).agg(F.max("pos").alias("pos"), F.max("end").alias("end")).collect()
    pos = np.concatenate([line.pos, np.array([r["pos"] for r in new], dtype=np.int64)])
    end = np.concatenate([line.end, np.array([r["end"] for r in new], dtype=np.int64)])
    pos, first = np.unique(pos, return_index=True)
    return Line(pos, end[first])


def _giants(sums: DataFrame, total: int, shards: int) -> tuple[list[tuple[int, int]], int]:
    """(hash, bytes) of the groups larger than an even share of what is left without them, and the bytes of the others."""
    found: list[tuple[int, int]] = []
    for r in sums.orderBy(F.desc("bytes"), "_h").select("_h", "bytes").limit(shards - 1).collect():
        if r["bytes"] * (shards - len(found)) <= total:
            break
        found.append((r["_h"], r["bytes"]))
        total -= r["bytes"]
    return found, total


def minimax_cuts(sums: DataFrame, shards: int, cells: int = 16_384, rows_a_task: int = 50_000) -> tuple[int, list[int | None], list[int]]:
    """(capacity, cuts, giants) for the written table ``sums`` (_h, bytes), a row for each group, ``bytes`` at least 1.

    A group that is no giant goes to the shard numbered by how many cuts are below its hash (a null cut is below all);
    the giants follow, one shard each, in the order given.
    """
    n, total = sums.agg(F.count("*"), F.sum("bytes")).first()
    if not n:
        return 0, [], []
    giants, total = _giants(sums, int(total), shards)
    hashes, largest, shards, n = [h for h, _ in giants], max((b for _, b in giants), default=0), shards - len(giants), int(n) - len(giants)
    if not n:
        return largest, [], hashes
    rest = sums.where(~F.col("_h").isin(hashes)) if giants else sums
    # Range partitions are pieces of the line; written with their numbers they stay as they are.
    dealt = rest.select("_h", "bytes").repartitionByRange(max(8, -(-n // rows_a_task)), "_h")
    dealt = cut_lineage(dealt.select("_h", "bytes", F.spark_partition_id().alias("_part"), F.lit(0).alias("_all")))
    placed = running_start(dealt, ["_all"], "_part", [F.col("_h")], F.col("bytes"), "_before")
    placed = running_start(placed, ["_all"], "_part", [F.col("_h")], F.lit(1).cast("long"), "pos")
    groups = cut_lineage(placed.select("_h", "pos", (F.col("_before") + F.col("bytes")).alias("end")).sortWithinPartitions("pos"))
    line = Line(np.array([-1, n - 1]), np.array([0, total]))
    if n > 1:
        line = _refined(line, groups, {0}, cells)
    even, most = -(-total // shards), rest.agg(F.max("bytes")).first()[0]
    no, yes = max(even, most) - 1, even + most  # no capacity up to the first can do, the second always does
    while True:
        no, yes = line.search(shards, no, yes)
        if no + 1 == yes:
            break
        line = _refined(line, groups, line.hidden(no, yes, shards), cells)
    cuts = line.cuts(yes, shards)
    at = {r["pos"]: r["_h"] for r in groups.where(F.col("pos").isin(sorted(set(cuts)))).select("pos", "_h").collect()}
    return max(yes, largest), [at.get(p) for p in cuts], hashes


def shard_of(h: Column, cuts: list[int | None], giants: list[int]) -> Column:
    """The shard of the group with hash ``h``."""
    found = F.lit(0)
    for c in cuts:
        found = found + (F.lit(1) if c is None else F.when(h > c, 1).otherwise(0))
    for i, g in reversed(list(enumerate(giants))):
        found = F.when(h == g, len(cuts) + 1 + i if cuts or giants else 0).otherwise(found)
    return found.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, keep_text: bool = True, cells: int = 16_384, rows_a_piece: int = 100_000) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``shard`` and ``slot``, which counts from 0 in
    each shard; columns of these names are replaced. Reruns over the same files agree.

    Texts are read once for their hashes, and move (if they are kept) only where slots are counted: a shard is counted in
    pieces of its rows, so one with a third of all rows is counted by many tasks.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot") and (keep_text or c != "text")]
    own = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc")  # so that no name of a column clashes with ours
    seen = docs.select(
        own, (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_h"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("_draw"),
    )
    seen = cut_lineage(seen)
    sums = cut_lineage(seen.groupBy("_h").agg(F.sum("size").alias("bytes")))
    _, cuts, giants = minimax_cuts(sums, shards, cells)
    pieces = max(64, -(-seen.count() // rows_a_piece))
    dealt = seen.select("*", shard_of(F.col("_h"), cuts, giants).alias("shard"), F.pmod(F.col("_draw"), F.lit(pieces)).alias("_piece"))
    placed = running_start(dealt, ["shard"], "_piece", [F.col("_h"), F.col("_draw")], F.lit(1).cast("long"), "slot")
    return placed.select(*[F.col(f"_doc.`{c}`").alias(c) for c in kept], "size", "text_crc32", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Write the rows of ``shard_documents`` as Parquet, a folder for each shard, in order of slots. A large shard is several
    files, each written by a task of its own."""
    piece = fresh(sharded, "_piece")
    dealt = sharded.withColumn(piece, F.floor(F.col("slot") / rows_a_file)).repartition("shard", piece)
    dealt.sortWithinPartitions("shard", "slot").drop(piece).write.partitionBy("shard").parquet(path)
