"""How document filters interact: what each one removes in every order, by a Gray-code walk over the subsets of filters.

Every document gets the mask of the filters it fails, and documents of a part that fail the same filters are one *cell*
(at most 32 of them), so the corpus is read once and what follows works on cells. The walk visits the 32 subsets of
filters in Gray-code order: a step switches one filter on or off, which moves the active-failure counter of each cell that
fails it by one, and only cells whose counter leaves or reaches 0 change the running survivors. The survivors of each
state are stored. A filter applied after others removes the difference of two states, so all 120 orders, the shares of
Shapley and the losses by label are differences of stored states.

Filters (words are runs of what is neither space nor tab .. carriage return): A under 50 words; B fewer than 65 distinct
words in 100; C more than 5 capitals A-Z in 100 code points; D holds one of ``# $ % & * |``; E the same text has a smaller
``doc_id`` somewhere in the table.

Defined cases: a null text counts as empty, which fails A alone (and E, if a smaller id has it); a null source is the part
with the empty name, as an empty one is; a row with a null id has no label, never fails E and makes no other row fail it; of
repeated rows with one id none is smaller; a document with several labels is good, or toxic, if one of them says so; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
MARKS = "[#$%&*|]"


def content_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))

    def mask(w: Column) -> Column:
        fails = (F.size(w) < 50, F.size(F.array_distinct(w)) * 100 < F.size(w) * 65, capitals.cast("long") * 100 > F.length(text) * 5, text.rlike(MARKS))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words), mask)[0]  # a lambda over one item: the words are found once


def filter_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): the documents of each part by the set of filters that they fail.

    Only ids, hashes and masks are shuffled. Copies are counted by text and part before they meet, and each text keeps the
    least id of a part with what is counted under it, so a text with a third of all rows is a few rows for each task.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.unhex(F.sha2(body, 256)).alias("_text"), F.coalesce("source", F.lit("")).alias("part"), content_mask(body).alias("mask"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("_g"), F.max(F.col("toxic") == 1).alias("_t"))
    # Rows without an id, however many, have no label to look for.
    known, nameless = seen.where("doc_id is not null").join(said, "doc_id", "left"), seen.where("doc_id is null")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    by_id = known.groupBy("doc_id", "_text", "part", "mask").agg(F.count("*").alias("_n"), one("_g"), one("_t"))
    zero = F.lit(0).cast("long")
    none = nameless.groupBy("_text", "part", "mask").agg(F.count("*").alias("_n"))
    counted = ("_n", "_g", "_t")
    by_text = by_id.groupBy("_text", "part", "mask").agg(*[F.sum(c).alias(c) for c in counted], F.min(F.struct("doc_id", *counted)).alias("_least"))
    least = by_text.groupBy("_text").agg(F.min("_least.doc_id").alias("_id"))
    # Those under the least id of a text pass E; the others under an id are copies of it.
    same = by_text.join(least, "_text")
    first = lambda c: F.when(F.col("_least.doc_id") == F.col("_id"), F.col(f"_least.{c}")).otherwise(zero)
    passes = same.select("part", "mask", *[first(c).alias(c) for c in counted])
    copies = same.select("part", (F.col("mask") + 16).alias("mask"), *[(F.col(c) - first(c)).alias(c) for c in counted])
    cells = passes.unionByName(copies).unionByName(none.select("part", "mask", "_n", zero.alias("_g"), zero.alias("_t"))).where("_n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("_n").alias("docs"), F.sum("_g").alias("good"), F.sum("_t").alias("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What survives each subset of the filters (a row for each subset, by its bits), for cells with ``counts``."""
    active, alive = np.zeros(len(masks), dtype=np.int64), counts.sum(axis=0)
    states = np.zeros((1 << len(FILTERS), counts.shape[1]), dtype=np.int64)
    states[0], on = alive, 0
    for i in range(1, 1 << len(FILTERS)):
        bit = i & -i  # the filter that the i-th step of a reflected Gray code toggles
        on ^= bit
        failing = masks & bit > 0
        if on & bit:
            alive = alive - counts[failing & (active == 0)].sum(axis=0)
            active = active + failing
        else:
            active = active - failing
            alive = alive + counts[failing & (active == 0)].sum(axis=0)
        states[on] = alive
    return states


def _orders(part: str, masks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The rows of the audit of one part."""
    states, k = walk(masks, counts), len(FILTERS)
    everything = (1 << k) - 1
    fails = [states[0, 0] - states[1 << f, 0] for f in range(k)]
    alone = [states[everything ^ 1 << f, 0] - states[everything, 0] for f in range(k)]
    # Each subset without a filter comes right before it in |S|! (k - 1 - |S|)! of the orders.
    times = [math.factorial(bin(s).count("1")) * math.factorial(k - 1 - bin(s).count("1")) if bin(s).count("1") < k else 0 for s in range(1 << k)]
    shapley = [sum(times[s] * (states[s, 0] - states[s | 1 << f, 0]) for s in range(1 << k) if not s >> f & 1) for f in range(k)]
    rows = []
    for order in itertools.permutations(range(k)):
        name, on = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            before, on = states[on], on | 1 << f
            gone = before - states[on]
            rows.append((part, name, step, states[on, 0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in AUDIT.split(", ")])


AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def filter_interactions(cells: DataFrame) -> DataFrame:
    """For each part of ``filter_cells``, every order of the filters and every step of it: ``kept`` and ``removed`` there,
    ``redundant`` (failing the step's filter, gone before), ``unique_fails`` (failing it alone), ``good_lost``, ``toxic_lost``
    and ``shapley`` (what the filter removes, summed over all orders). Each part is a task's work on 32 cells at most."""

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, masks, counts in zip(batch["part"], batch["masks"], batch["counts"]):
                yield _orders(part, np.array(list(masks), dtype=np.int64), np.stack([np.array(list(c), dtype=np.int64) for c in counts]))

    of_part = F.array_sort(F.collect_list(F.struct("mask", F.array("docs", "good", "toxic").alias("counts"))))
    parts = cells.groupBy("part").agg(of_part.alias("_cells")).select("part", F.col("_cells.mask").alias("masks"), F.col("_cells.counts").alias("counts"))
    return parts.mapInPandas(audit, AUDIT)
