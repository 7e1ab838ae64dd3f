"""Harmonic packing of token ids into fixed-length training sequences.

A document longer than the capacity C gives whole sequences and a rest; a shorter one is a piece by itself. A piece of
length L has the reciprocal class k = floor(C / L), so C/(k+1) < L <= C/k, and a bin of class k takes exactly k pieces.
A piece's bin follows from its rank in its class alone, and ranks come from a two-level count, so workers fill bins
independently of each other and no task sees a whole class.

The gap that is left in each bin is known, and is filled from a reserve: pieces whose hash falls below a bound, and the
pieces of a class that no longer fill a bin. The reserve's tokens form one line, the gaps another; running sums place
both, and where a gap and a reserved piece overlap, that cut of the piece goes into the gap. The bound is the least at
which the reserve fills all gaps, out of a table of counts by class and hash cell. What the reserve has beyond the gaps
becomes sequences of C tokens, and its last few tokens sequences whose lengths are powers of two. So nothing is padded,
and only long and reserved documents are cut. Where a table is too small for any bin, all of it is reserve.

Defined cases: a null or empty text is the end token alone; repeated rows are packed one by one; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage
from .offsets import running_start
from .tokens import default_path, tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: Cells of the hash that orders pieces; with the classes (128 for C = 4096) they bound the table that reaches the driver.
CELLS, HASH_BITS = 512, 20
#: Rows that a worker hands on at a time.
HANDED = 4096


def tokenize(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 2, whole_ids: bool = False) -> DataFrame:
    """The whole sequences of each document (columns ``doc_id``, ``text``) and its rest, with the rest's token ids as
    little-endian 32-bit numbers (``whole_ids``: those of whole sequences too)."""
    path, names = path or default_path(), [x.split()[0] for x in PIECES.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokenizer(path).encode, np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = (encode(text) if text else b"") + end
                n, doc_id = len(ids) // 4, None if pd.isna(doc_id) else int(doc_id)
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, piece if length < capacity or whole_ids else None))
                    if len(rows) >= HANDED:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def plan_bins(counts: np.ndarray, tokens: np.ndarray, capacity: int) -> int:
    """The least number of hash cells whose pieces, with those that fill no bin, fill the gaps of all bins.

    ``counts[k, c]``, ``tokens[k, c]``: pieces of class k (row 0 unused) and hash cell c, without whole sequences.
    """
    cells = counts.shape[1]
    k = np.maximum(np.arange(len(counts)), 1)
    for c in range(cells):
        n, t = counts[:, c:].sum(axis=1), tokens[:, c:].sum(axis=1)
        bins = n // k
        over = t * (n - bins * k) / np.maximum(n, 1)  # tokens of the pieces that fill no bin, by the class's mean
        gaps = (bins * capacity - (t - over)).sum()
        if bins.sum() > 0 and tokens[:, :c].sum() + over.sum() >= 1.005 * gaps + capacity:
            return c
    return cells


def _literal(values: dict[int, int], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in (values or {-1: 0}).items() for x in kv]), key), F.lit(0)).cast("long")


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 2, with_ids: bool = False, rows_a_task: int = 100_000) -> DataFrame:
    """Each piece with the ``sequence_id`` (gapless from 0) and the ``offset`` it lies at.

    Pieces with their token ids are written to the shared folder once, so texts are tokenized once. To the driver come
    a row for each class and hash cell, and two sums.
    """
    spark = docs.sparkSession
    h = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1 << HASH_BITS))
    pieces = tokenize(docs, capacity, path, end_id, with_ids).withColumn("_h", h).withColumn("_row", F.monotonically_increasing_id())
    pieces = cut_lineage(pieces.withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("int")))
    cell, part_whole = F.shiftright(F.col("_h") * CELLS, HASH_BITS), F.col("length") == capacity
    seen = pieces.groupBy("_k", part_whole.alias("whole"), cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    counts, tokens = (np.zeros((capacity + 1, CELLS), dtype=np.int64) for _ in range(2))
    wholes = np.zeros(CELLS, dtype=np.int64)
    for r in seen:
        if r["whole"]:
            wholes[r["cell"]] += r["n"]
        else:
            counts[r["_k"], r["cell"]], tokens[r["_k"], r["cell"]] = r["n"], r["t"]
    reserved = plan_bins(counts, tokens, capacity)
    kept = counts[:, reserved:].sum(axis=1)
    kept[1] += wholes.sum()
    k_all = np.flatnonzero(kept)
    bins = {int(k): int(kept[k] // k) for k in k_all}
    base = dict(zip(bins, np.concatenate(([0], np.cumsum(list(bins.values()))))[:-1].tolist())) if bins else {}
    n_bins, n_rows = sum(bins.values()), int(counts.sum() + wholes.sum())
    # The pieces that fill no bin have the largest hashes of their class: all of them lie in the cells from here on.
    late = {k: int(np.flatnonzero(np.cumsum(counts[k, ::-1] + (wholes[::-1] if k == 1 else 0)) >= kept[k] % k)[0]) if kept[k] % k else -1 for k in bins}
    late = {k: CELLS - 1 - v if v >= 0 else CELLS for k, v in late.items()}

    parts = max(8, -(-n_rows // rows_a_task))
    order = [F.col(c) for c in ("_h", "doc_id", "start", "ids_crc32", "doc_tokens", "_row")]
    slim = pieces.drop("ids").withColumn("_part", F.shiftright(F.col("_h") * parts, HASH_BITS)).withColumn("_one", F.lit(1))
    in_reserve = (cell < reserved) & ~part_whole
    ranked = running_start(slim.where(~in_reserve), ["_k"], "_part", order, F.lit(1), "_rank")
    ranked = ranked.withColumn("_in", F.col("_rank") < _literal({k: k * n for k, n in bins.items()}, F.col("_k")))
    ranked = cut_lineage(ranked)
    binned = ranked.where("_in").withColumn("sequence_id", _literal(base, F.col("_k")) + F.floor(F.col("_rank") / F.col("_k")))
    inside = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    gaps = binned.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("gap")).where("gap > 0")
    gaps = gaps.withColumn("_part", F.floor(F.col("sequence_id") / rows_a_task)).withColumn("_one", F.lit(1))
    gaps = cut_lineage(running_start(gaps, ["_one"], "_part", [F.col("sequence_id")], F.col("gap"), "at").select("sequence_id", (F.lit(capacity) - F.col("gap")).alias("from"), "at", "gap"))
    reserve = slim.where(in_reserve).unionByName(ranked.where("not _in").select(slim.columns))
    reserve = cut_lineage(running_start(reserve, ["_one"], "_part", order, F.col("length"), "at").select("_row", "at", F.col("length").alias("size")))
    room, held = (df.agg(F.sum(c)).first()[0] or 0 for df, c in ((gaps, "gap"), (reserve, "size")))
    more, rest = divmod(max(0, held - room), capacity)
    ends = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    own = spark.range(more).select((F.lit(n_bins) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("from"), (F.lit(room) + F.col("id") * capacity).alias("at"), F.lit(capacity).cast("long").alias("gap"))
    last = [(n_bins + more + i, 0, room + more * capacity + sum(ends[:i]), n) for i, n in enumerate(ends)]
    gaps = gaps.unionByName(own).unionByName(spark.createDataFrame(last, "sequence_id long, `from` long, at long, gap long"))

    filled = _overlaps(gaps, reserve, capacity)
    wanted = (cell < reserved) | (cell >= _literal(late, F.col("_k")))
    texts = pieces.where(~part_whole & wanted).select("_row", "doc_id", F.col("start").alias("_start"), "doc_tokens", "ids")
    cut = filled.join(texts, "_row").withColumn("ids", F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * length as int))"))
    cut = cut.select("doc_id", (F.col("_start") + F.col("skip")).alias("start"), "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
    if with_ids:
        binned = binned.join(pieces.select("_row", "ids"), "_row")
    return binned.select(*cut.columns).unionByName(cut)


def _overlaps(gaps: DataFrame, reserve: DataFrame, capacity: int) -> DataFrame:
    """``_row, skip, length, sequence_id, offset``: each stretch of the line that one gap and one reserved piece share.

    Gaps (sequence_id, from, at, gap) and pieces (_row, at, size) both cover the line without holes. Their starts cut it
    into stretches, found by one window over cells of ``capacity`` tokens: no pair of a gap and a piece is made that do
    not meet. A gap or piece that goes on into the next cell has a mark at the cell's start, which is no cut.
    """

    def marks(df: DataFrame, size: str, what: Column, name: str) -> DataFrame:
        to = F.col("at") + F.col(size)
        cells = F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((to - 1) / capacity)))
        df = df.select("at", what.alias(name), cells.alias("cell"))
        return df.select("cell", F.greatest("at", F.col("cell") * capacity).alias("pos"), name)

    gap = marks(gaps, "gap", F.struct("at", (F.col("at") + F.col("gap")).alias("to"), "sequence_id", "from"), "g")
    piece = marks(reserve, "size", F.struct("at", (F.col("at") + F.col("size")).alias("to"), "_row"), "p")
    both = gap.unionByName(piece, allowMissingColumns=True).groupBy("cell", "pos").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    line = Window.partitionBy("cell").orderBy("pos")
    last = lambda c: F.last(c, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    cut = both.select("pos", last("g"), last("p"), F.coalesce(F.lead("pos").over(line), (F.col("cell") + 1) * capacity).alias("end"))
    cut = cut.withColumn("end", F.least("end", "g.to", "p.to")).where("pos < end and g is not null and p is not null")
    cut = cut.groupBy("p._row", "g.sequence_id").agg(F.min("pos").alias("pos"), F.max("end").alias("end"), F.first("g").alias("g"), F.first("p").alias("p"))
    return cut.select("_row", (F.col("pos") - F.col("p.at")).alias("skip"), (F.col("end") - F.col("pos")).alias("length"), "sequence_id", (F.col("g.from") + F.col("pos") - F.col("g.at")).alias("offset"))
