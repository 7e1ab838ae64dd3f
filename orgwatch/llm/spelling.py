"""Spelling variants: frequent words that differ by one code point, and the commoner word that a rarer one stands for.

Near words are found by asymmetric q-chunks. Of two words within one edit, the longer (of equal ones the lesser) gives two
disjoint chunks, its halves; the other gives its positional grams of that length. One edit spoils one chunk at most, so a
chunk of the one is a gram of the other, at a position that differs by one at most; grams at other positions can meet no
chunk and are not made. What shares a chunk is a candidate and is verified by its exact edit distance.

A chunk that too many words share (``pairs`` candidates and more) is not joined: it is taken out of its words, and what is
left of two near words is within one edit again, so the same scheme is applied to the rests, under both chunks as the key.
This goes on until a key is small or a rest has one code point; the words of such a key differ in one place, so they are no
more than the alphabet. No pair is lost, and no candidates are capped.

Defined cases: a null, empty or letterless text has no words; a null id counts as empty text before the colon; repeated rows
count as often as they come; a tie of counts goes to the word least in code-point order; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Maximal runs of letters; only A-Z are lowered.
RUN = r"[a-zÀ-ÿ]"


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, spoil: int = 199) -> DataFrame:
    """(word, n): the words of all whole texts with ``least_length`` code points and ``least_count`` occurrences or more.

    A run of letters whose checksum with its document's id is a multiple of ``spoil`` loses the code point that the checksum
    names. Runs that are too short before can only become shorter, so they are not looked at. Counts are summed by task
    before the shuffle.
    """
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_id")
    runs = docs.select(named, F.explode(F.regexp_extract_all(lower, F.lit(f"{RUN}{{{least_length},}}+"), F.lit(0))).alias("_run"))
    h = F.crc32(F.concat("_id", "_run").cast("binary"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    shorter = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = runs.withColumn("_h", h).select(F.when(F.col("_h") % spoil == 0, shorter).otherwise(F.col("_run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _chunks(rest: Column) -> Column:
    """The two disjoint chunks of a word, each with its place and what is left of the word without it."""
    q = F.floor(F.length(rest) / 2).cast("int")
    return F.array(*[_gram(rest, p, q, i) for i, p in enumerate((F.lit(0), q))])


def _gram(rest: Column, at: Column, q: Column, chunk: int) -> Column:
    return F.struct(F.lit(chunk).alias("chunk"), F.substr(rest, at + 1, q).alias("gram"), F.concat(F.substr(rest, F.lit(1), at), F.substr(rest, at + q + 1)).alias("rest"))


def _grams(rest: Column, longer: Column) -> Column:
    """The positional grams of a word that the chunks of a word longer by ``longer`` (0 or 1) can meet."""
    q = F.floor((F.length(rest) + longer) / 2).cast("int")
    # Its first chunk is at 0; its second one at q, or at q - 1 where the code point that the longer word has more comes before.
    shifted = F.when(longer == 1, F.array(_gram(rest, q - 1, q, 1)))
    fits = F.when(F.length(rest) >= 2 * q, F.array(_gram(rest, q, q, 1)))
    none = F.array().cast("array<struct<chunk:int,gram:string,rest:string>>")
    return F.concat(F.array(_gram(rest, F.lit(0), q, 0)), F.coalesce(shifted, none), F.coalesce(fits, none))


def _deeper(rows: DataFrame, grams: Column) -> DataFrame:
    """``rows`` (word, n, longer, key, rest) under the keys one level down, a row for each of ``grams``."""
    found = F.explode(F.array_distinct(grams)).alias("_g")
    key = F.concat_ws("|", "key", F.col("_g.chunk"), F.col("_g.gram"))
    return rows.select("word", "n", "longer", "key", "rest", found).select("word", "n", "longer", key.alias("key"), F.col("_g.rest").alias("rest"))


def near_words(words: DataFrame, pairs: int = 100_000) -> DataFrame:
    """(word, n, near, near_n) for every two words of ``words`` (word, n) that one inserted, deleted or replaced code point
    makes equal, in both directions."""
    words = words.select("word", F.col("n").cast("long").alias("n"), F.col("word").alias("rest"))
    # A key begins with the length of the word that gives the chunks and by how much it is the longer one.
    length = lambda more: F.concat((F.length("word") + more).cast("string"), F.lit("+"), F.col("longer").cast("string"))
    either = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    given, asked = either.withColumn("key", length(F.lit(0))), either.withColumn("key", length(F.col("longer")))
    found = None
    while True:
        given = cut_lineage(_deeper(given, _chunks(F.col("rest"))))
        asked = cut_lineage(_deeper(asked, _grams(F.col("rest"), F.col("longer"))))
        count = lambda df, c: df.groupBy("key").agg(F.count("*").alias(c), F.min(F.length("rest")).alias(f"{c}_rest"))
        both = count(given, "_c").join(count(asked, "_a"), "key").where(f"_c * _a > {pairs} and _c_rest > 1").select("key")
        hot = cut_lineage(both)
        some = not hot.isEmpty()
        joined = (given.join(hot, "key", "left_anti"), asked.join(hot, "key", "left_anti")) if some else (given, asked)
        left = joined[0].select("key", "word", "n")
        right = joined[1].select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        once = (F.length("word") > F.length("near")) | (F.col("word") < F.col("near"))
        verified = left.join(right, "key").where(once & (F.levenshtein("word", "near", 1) == 1)).drop("key")
        found = verified if found is None else found.unionByName(verified)
        if not some:
            break
        given, asked = given.join(hot, "key", "left_semi"), asked.join(hot, "key", "left_semi")
    one = found.distinct()
    return one.unionByName(one.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def group_spellings(words: DataFrame, ratio: int = 5, pairs: int = 100_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (word, n).

    ``form`` is the near word of the largest count if that is ``ratio`` times the word's own or more. Counts grow by that
    factor along forms, so a chain of them has no cycle and at most log(largest count) links; pointers that double the way
    they have gone reach its end in log2 of that many joins, over the words that have a form alone.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could run in a circle")
    words = cut_lineage(words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words, pairs).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("_best"))
    form_n = -F.col("_best.m")
    near = cut_lineage(near.select("word", "n", "n_near", F.when(form_n >= F.col("n") * ratio, F.col("_best.near")).alias("form"), form_n.alias("form_n")))
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n"), F.min("n")).first()
    steps = int(math.log(max(1, (most[0] or 1) / (most[1] or 1)), ratio)) + 1
    for _ in range(max(0, steps - 1).bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = cut_lineage(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    some = near.join(links, "word", "left").select("word", "n_near", "form", "root", F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
    return words.join(some, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
