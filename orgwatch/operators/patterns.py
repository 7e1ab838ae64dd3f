"""Many literal patterns at once: which of them each text holds, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_patterns(rows: DataFrame, text: str, patterns: DataFrame, pattern: str, most: int = 4_000_000) -> DataFrame:
    """``rows`` without ``text``, a row for each pattern that its text holds, with the pattern under its own name.

    Patterns become an automaton that reads a text once, whatever their number, and only true hits become rows. The
    patterns of a block (``most`` code points) are sent to the tasks; beyond that there are several blocks, dealt by hash,
    and the texts are read once for each. A null text holds nothing; null and empty patterns are in no text; repeated
    patterns count once.
    """
    wanted = patterns.select(F.col(pattern).alias("p")).where("p <> ''").distinct()
    total = wanted.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, -(-total // most))
    kept = [f for f in rows.schema.fields if f.name not in (text, pattern)]
    schema = T.StructType([*kept, T.StructField(pattern, T.StringType())])
    found = None
    for block in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == block)
        words = [r["p"] for r in own.collect()]
        hits = rows.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(_scanner(words, pattern), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _scanner(words: list[str], pattern: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            at, hit = [], []
            for i, t in enumerate(batch.column("_text").to_pylist() if words else []):
                for w in sorted({w for _, w in automaton.iter(t)} if t else ()):
                    at.append(i)
                    hit.append(w)
            kept = batch.drop_columns(["_text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hit, pa.string())], names=[*kept.schema.names, pattern])

    return scan
