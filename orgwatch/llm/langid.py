"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of its hashed character n-grams (1 to 3 letters; whatever is not a letter
separates). The document frequencies behind IDF are counted over all training rows. The centroids of a language come
from spherical k-means over a bounded sample of its rows (``sample`` rows at most in expectation, a documented
parameter), one language a task. A text gets the language of the nearest centroid by cosine; it is rejected where the
cosine falls below what ``reject_quantile`` of that centroid's own members reach, scaled by ``reject_scale``.

Defined cases: a null text or one without letters gives ``und``, score 0, rejected; without training rows every text
does; ties between centroids go to the language that is first by code point; rows are classified one by one, so
repeats agree; extra columns are ignored by ``fit`` and pass through ``predict``. Languages are labels, few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BITS = 13
WIDTH = 1 << BITS


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or 32 where it is no letter."""
    every = map(chr, range(0x110000))
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i, c in enumerate(every):
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _grams(text: str) -> np.ndarray:
    """Hashed n-gram counts of one text."""
    x = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    x = np.concatenate(([32], x, [32])).astype(np.uint32)
    blank = x == 32
    x = x[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(x) < 3:
        return np.zeros(WIDTH, dtype=np.int64)
    a = x * np.uint32(0x9E3779B1)
    b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[1:] * np.uint32(0xC2B2AE35)
    c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - BITS)
    return np.bincount(np.concatenate((a[x != 32] >> shift, b >> shift, c >> shift)), minlength=WIDTH)


def _vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """A row for each text; zero for a text without letters."""
    tf = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, t in enumerate(texts):
        if t:
            tf[i] = _grams(t)
    np.log1p(tf, out=tf)
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
    return tf


@dataclass(frozen=True)
class Centroids:
    """A fitted model: a few rows for each language."""

    languages: list[str]
    matrix: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from rows that are far apart; (centroids, each row's own one and its cosine with that)."""
    first = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[first[0]]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    cos = x @ c.T
    return c, np.stack([np.argmax(cos, axis=1), cos.max(axis=1)])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", clusters: int = 3, sample: int = 600, reject_quantile: float = 0.01, reject_scale: float = 0.5) -> Centroids:
    """Learn from the rows of ``train`` whose language is not null.

    To the driver come one number for each n-gram bucket, one count for each language and ``clusters`` rows for each
    language; none of them grows with the corpus.
    """
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                total += _grams(t) > 0
                n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, WIDTH), "n": np.concatenate(([n], total))})

    counted = rows.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WIDTH)
    n = 0
    for r in counted:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Centroids([], np.zeros((0, WIDTH), np.float32), np.zeros(0), idf)
    # A row is in the sample by the hash of its text, so that runs agree, and copies count once (summed map-side before
    # they meet); the share falls as a language's rows grow.
    draw: Column = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, sample / v))]), F.col("lang"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in group["text"] if len(t) > 0)
        x = _vectors(texts, idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "place": [], "centroid": [], "floor": []})
        c, (own, cos) = _kmeans(x, clusters)
        floor = [float(np.quantile(cos[own == j], reject_quantile)) * reject_scale if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "place": range(len(c)), "centroid": list(c), "floor": floor})

    found = rows.where(draw < share).distinct().groupBy("lang").applyInPandas(cluster, "lang string, place int, centroid array<float>, floor double")
    got = sorted(found.collect(), key=lambda r: (r["lang"].encode(), r["place"]))
    matrix = np.array([r["centroid"] for r in got], dtype=np.float32).reshape(len(got), WIDTH)
    return Centroids([r["lang"] for r in got], matrix, np.array([r["floor"] for r in got]), idf)


def predict(docs: DataFrame, model: Centroids, text: str = "text", block: int = 256) -> DataFrame:
    """``docs`` with ``text`` replaced by ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters rows of WIDTH floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts, out = list(batch), []
            for at in range(0, len(texts), block):
                part = texts[at : at + block]
                x = _vectors(part, m.idf)
                known = np.linalg.norm(x, axis=1) > 0.5
                if m.languages:
                    cos = x @ m.matrix.T
                    best = np.argmax(cos, axis=1)
                    top = np.clip(cos[np.arange(len(part)), best].astype(float), 0, 1)
                    out += [(m.languages[b], float(s), bool(s < m.floors[b])) if k else ("und", 0.0, True) for b, s, k in zip(best, top, known)]
                else:
                    out += [("und", 0.0, True)] * len(part)
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")]
    p = fresh(docs, "_p")
    return docs.withColumn(p, nearest(F.col(text))).select(*rest, f"{p}.lang_pred", f"{p}.score", f"{p}.rejected")
