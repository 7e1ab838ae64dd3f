"""Functions that need Unicode decomposition, and one on pairs of texts, in Python by batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import WIDE_HAN, up_to_last


def decomposed(c: Column) -> Column:
    """Compatibility decomposition by the Unicode library that Spark brings along: a text at a time, without Python."""
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True)))


def nfkd(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(decomposed(c), r"\p{M}+", "")).otherwise(c)


def norm_ascii_han(c: Column) -> Column:
    """Lower case; letters a-z, digits and Han; single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkd(c)), rf"[^a-z0-9{WIDE_HAN}]+", " "))


def compact(c: Column) -> Column:
    return F.replace(norm_ascii_han(c), F.lit(" "), F.lit(""))


def norm_letters(c: Column) -> Column:
    """Lower case without tags; letters and digits of any script; single spaces."""
    # As text.drop_tags, but without a lambda, inside which nothing is compiled.
    head = up_to_last(c, ">")
    bare = F.concat(F.regexp_replace(head, "<[^>]*>", " "), F.substr(c, F.length(head) + 1))
    return F.trim(F.regexp_replace(F.lower(nfkd(bare)), r"[^\p{L}\p{N}]+", " "))


def slug(c: Column, longest: int = 72) -> Column:
    """Letters a-z and digits joined by hyphens; a digest where a name has none."""
    readable = F.regexp_replace(F.regexp_replace(F.lower(nfkd(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(readable, 1, longest)
    return F.when(cut != "", cut).otherwise(F.concat(F.lit("source-"), F.substring(F.sha2(c, 256), 1, 16)))


@F.pandas_udf(IntegerType())
def lcs_len(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common substring, by a suffix automaton of the shorter text: memory as its length."""

    def one(a: str | None, b: str | None) -> int:
        if not a or not b:
            return 0
        a, b = sorted((a, b), key=len)
        step, link, length, last = [{}], [-1], [0], 0
        for x in a:
            new, p = len(step), last
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and x not in step[p]:
                step[p][x] = new
                p = link[p]
            if p >= 0:
                q = step[p][x]
                if length[q] > length[p] + 1:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(x) == q:
                        step[p][x] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
        best = n = at = 0
        for x in b:
            while at and x not in step[at]:
                at = link[at]
                n = length[at]
            if x in step[at]:
                at, n = step[at][x], n + 1
                best = max(best, n)
        return best

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int32")
