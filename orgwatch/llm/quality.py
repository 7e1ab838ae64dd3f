"""Quality rules by weak supervision.

Rules vote good (+1) or bad (-1) on a document or abstain (0). The accuracies of the rules are not given:
expectation-maximisation estimates, for either class, how often each rule casts each vote, from the counts of
the vote patterns of *all* documents. At most ``3 ** len(RULES)`` patterns exist, whatever the corpus, so the
pattern table is the only thing that reaches the driver. The posterior probability of the class good then
decides, in place of a filter that all rules must pass.

Defined cases: a null text has no words (all features 0, fails the base rules); extra columns pass through
``score_quality`` untouched; an empty table gives an empty result; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut_lineage, fresh

_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"

FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_letters", "n_upper", "n_distinct", "n_bangs", "n_stops")]
)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point 1 (symbol) + 2 (letter) + 4 (upper case) + 8 (exclamation mark) + 16 (ends a sentence)."""
    every = "".join(map(chr, range(0x110000)))
    out = 2 * np.fromiter(map(str.isalpha, every), np.uint8, len(every)) + 4 * np.fromiter(map(str.isupper, every), np.uint8, len(every))
    for chars, bit in ((_SYMBOLS, 1), ("!", 8), (".!?", 16)):
        out[[ord(c) for c in chars]] += bit
    return out.astype(np.uint8)


def _repeated(words: list[str]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    if len(ids) < 2_000_000:
        key = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:  # three numbers no longer fit into 64 bits
        _, inverse, counts = np.unique(np.stack([w[:-2], w[1:-1], w[2:]]), axis=1, return_inverse=True, return_counts=True)
    often = counts[np.ravel(inverse)] > 1
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : k + n - 2] |= often
    return int(hit.sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The features of one text, in the order of FEATURES."""
    if not text:
        return (0,) * len(FEATURES)
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=32)
    symbols, letters, upper, bangs, stops = (int(kinds[[k for k in range(32) if k >> bit & 1]].sum()) for bit in range(5))
    return (
        len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), _repeated(words),
        len(lines), letters, upper, len(set(words)), bangs, stops,
    )


@F.pandas_udf(FEATURES)
def text_features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([features_of(t) for t in batch], columns=FEATURES.names, dtype="int64")


def rules(f: str = "_f") -> dict[str, Column]:
    """The labelling functions over the feature struct ``f``: -1 bad, 1 good, 0 abstain.

    A detector of one kind of junk votes bad or abstains: that it finds nothing says little about the other kinds.
    Only ``prose`` and ``sentences`` vote good.
    """
    c = lambda n: F.col(f"{f}.{n}")
    n, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    long = c("n_words") >= 20
    variety = c("n_distinct") / F.least(n, F.lit(400))
    bad = lambda when: F.when(when, F.lit(-1)).otherwise(F.lit(0))
    prose = long & (c("n_symbols") <= 0.05 * n) & c("word_chars").between(3 * n, 6.6 * n) & (variety >= 0.4)
    return {
        "symbols": bad(c("n_symbols") > 0.15 * n),
        "word_length": bad((c("word_chars") > 6.8 * n) | (c("word_chars") < 2.5 * n)),
        "repeats": bad(c("n_repeat_words") > 0.35 * n),
        "lines": bad(c("n_dup_lines") > 0.3 * F.greatest(c("n_lines"), F.lit(1))),
        "variety": bad(long & (variety < 0.25)),
        "capitals": bad(long & (c("n_upper") > 0.5 * letters)),
        "bangs": bad(c("n_bangs") > 0.2 * n),
        "prose": F.when(prose & (c("n_upper") < 0.3 * letters), F.lit(1)).otherwise(F.lit(0)),
        "sentences": F.when(c("n_stops").between(n / 60, n / 3), F.lit(1)).when(long & (c("n_stops") * 200 < n), F.lit(-1)).otherwise(F.lit(0)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """EM over vote patterns: (share of good documents, table[class, rule, vote + 1] of vote probabilities).

    Starts from the majority vote, smooths with one pseudo-document per cell, and stops when the share and the table
    no longer move. The pattern counts are whole-corpus counts, so a run costs the same at any corpus size.
    """
    m = patterns.shape[1]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = 1 / (1 + np.exp(-2.0 * (patterns.sum(axis=1) + 0.5)))
    share, table = 0.5, np.full((2, m, 3), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        new = np.einsum("cp,pmv->cmv", mass, onehot) + 1.0
        new /= new.sum(axis=2, keepdims=True)
        total = max(counts.sum(), 1)
        nshare = float((mass[1].sum() + 1) / (total + 2))
        moved = max(abs(nshare - share), float(np.abs(new - table).max()))
        share, table = nshare, new
        good = posterior(patterns, share, table)
        if moved < tolerance:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(table)
    m = np.arange(patterns.shape[1])
    bad, good = (logs[c][m, patterns + 1].sum(axis=1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -700, 700)))


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, min_words: int = 50, repeat_percent: int = 50, keep_text: bool = True) -> DataFrame:
    """``docs`` plus the features, ``votes``, ``quality_posterior``, ``base_failed`` and ``kept``; without ``keep_text``
    the result lacks the text.

    The features are computed once and written to the shared folder with what is kept of a document; two passes read
    them: one counts vote patterns (a few hundred rows out of map-side sums), one attaches each document's posterior as a
    constant expression over its votes (log-odds are sums of one term a rule), so nothing is joined or shuffled.
    """
    f, v = fresh(docs, "_f"), fresh(docs, "_v")
    voted = docs.withColumn(f, text_features(F.col(text)))
    voted = cut_lineage(voted if keep_text else voted.drop(text))
    votes = {k: vote.cast("int") for k, vote in rules(f).items()}
    seen = voted.select(*[vote.alias(k) for k, vote in votes.items()]).groupBy(*votes).agg(F.count("*").alias("_count")).orderBy(*votes).collect()  # at most 3 ** rules
    patterns = np.array([[r[k] for k in votes] for r in seen], dtype=int).reshape(len(seen), len(votes))
    share, table = estimate(patterns, np.array([r["_count"] for r in seen], dtype=float))
    weight = np.log(table[1]) - np.log(table[0])
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for i, k in enumerate(votes):
        cast = F.col(f"{v}.{k}")
        odds = odds + F.when(cast == -1, float(weight[i, 0])).when(cast == 0, float(weight[i, 1])).otherwise(float(weight[i, 2]))
    n = F.col(f"{f}.n_words")
    base_failed = (n < min_words) | (100 * F.col(f"{f}.n_repeat_words") > repeat_percent * n)
    taken = [x for x in docs.columns if (keep_text or x != text) and x not in {*FEATURES.names[:5], "votes", "quality_posterior", "base_failed", "kept"}]
    scored = voted.withColumn(v, F.struct(*[vote.alias(k) for k, vote in votes.items()]))
    scored = scored.withColumn("quality_posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed)
    return scored.select(
        *taken, *[F.col(f"{f}.{x}").alias(x) for x in FEATURES.names[:5]], F.col(v).alias("votes"), "quality_posterior",
        "base_failed", (~F.col("base_failed") & (F.col("quality_posterior") >= threshold)).alias("kept"),
    )
