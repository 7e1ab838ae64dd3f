"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents one after the other, are cut into blocks of fixed length. How many slots of an
output shard each source fills is one multinomial draw a shard: every slot draws its source by the sources' shares of the
targets. A source's slots count on over the shards, and a keyed permutation of the source's block indices (another one
each time through) says which block a slot takes. Blocks are joined by (source, index). The totals of such draws miss
the targets by about the square root of a source's slots; a final correction makes them exact: a source that has reached
its target takes no more, and what another lacks is added in further shards.

The number of passes through a source is bounded by ``cap``: slots beyond ``cap`` times its blocks do not exist, so no
block, and hence no document, is taken more often.

Defined cases: a null text has size 0 and nothing is taken of it; a null source is a source of its own, the last in
order; a source without words has target 0; repeated rows are documents of their own; an empty table gives an empty
result; extra columns are ignored by ``mix_plan`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut_lineage, numbered
from .offsets import running_start


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, _sid, source_size, target) of the table (source, size), a row for each source.

    Targets are ``share`` of all sizes, dealt by weight; a source stops at ``cap`` times its size and the excess goes to
    the others by weight. In the order of cap/weight the stopped sources come first, so running sums find them at once.
    The windows over all sources are one task each: sources are labels, a few million at most, however many documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    full = F.col("source_size") * F.lit(float(cap))
    dealt = sums.select("source", place.cast("long").alias("_sid"), "source_size", w.alias("_w"), full.alias("_cap"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_sid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    dealt = dealt.select(
        "*",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), zero)).alias("_rest"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero)).alias("_wrest"),
    )
    dealt = dealt.withColumn("_stopped", F.col("_cap") * F.col("_wrest") <= F.col("_w") * F.col("_rest"))
    level = F.min(F.when(~F.col("_stopped"), F.struct(F.col("_cap") / F.col("_w"), "_sid", (F.col("_rest") / F.col("_wrest")).alias("level")))).over(everything)
    return dealt.select("source", "_sid", "source_size", F.when(F.col("_stopped"), F.col("_cap")).otherwise(F.col("_w") * level["level"]).alias("target"))


def permuted(x: Column, n: Column, keys: list[Column], rounds: int = 16) -> Column:
    """A keyed permutation of 0 .. n-1, for any n: the swap-or-not shuffle, one bit of a hash for each round."""

    def step(at: Column, i: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("swap"), *keys, i), n) - at
        other = F.when(other < 0, other + n).otherwise(other)
        return F.when(F.pmod(F.xxhash64(F.lit("bit"), *keys, i, F.greatest(at, other)), F.lit(2)) == 0, at).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


def mix_slots(sources: DataFrame, seed: int, block_words: int, shard_slots: int, cap: float, slots_a_task: int = 100_000, cells: int = 1024) -> DataFrame:
    """(_sid, _shard, _slot, _block) for every slot of the mix. ``sources``: the rows of ``source_targets``.

    The slots are a range over as many tasks as they need, a shard after the other, and each draws its source for itself.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0.0)
    planned = sources.select("_sid", blocks.alias("_blocks"), F.least(wanted, F.floor(blocks * F.lit(float(cap)))).cast("long").alias("_want"))
    slots, rows = planned.agg(F.sum("_want"), F.count("*")).first()
    slots, cells = slots or 0, max(cells, 1 << (rows - 1).bit_length() if rows else 1)
    shards = -(-slots // shard_slots)
    upto = F.sum("_want").over(Window.orderBy("_sid"))
    spans = planned.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_want")).where("_want > 0")
    # A slot's number below the sum of all targets falls into the interval of one source, found by way of equal cells.
    cell = lambda c: F.floor(c * cells / max(slots, 1))
    spans = spans.select("_sid", "_from", "_to", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to") - 1))).alias("_cell"))
    drawn = spark.range(0, slots, 1, max(8, -(-slots // slots_a_task)))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(slots, 1)))
    drawn = drawn.select(F.floor(F.col("id") / shard_slots).alias("_shard"), number.alias("_u")).withColumn("_cell", cell(F.col("_u")))
    counts = drawn.join(spans, "_cell").where("_u >= _from and _u < _to").groupBy("_sid", "_shard").agg(F.count("*").alias("_n"))
    # The correction: what a source's draws lack comes in further shards, and what they have beyond its target is void.
    counts = cut_lineage(counts)
    got = counts.groupBy("_sid").agg(F.sum("_n").alias("_got"))
    lack = planned.join(got, "_sid", "left").select("_sid", (F.col("_want") - F.coalesce("_got", F.lit(0))).alias("_lack")).where("_lack > 0")
    lack = lack.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_lack") - 1) / shard_slots))))
    lack = lack.select("_sid", (F.lit(shards) + F.col("_j")).alias("_shard"), F.least(F.lit(shard_slots), F.col("_lack") - F.col("_j") * shard_slots).cast("long").alias("_n"))
    counts = counts.unionByName(lack).withColumn("_run", F.floor(F.col("_shard") / 4096))
    counts = running_start(counts, ["_sid"], "_run", [F.col("_shard")], F.col("_n"), "_first").join(planned, "_sid")
    counts = counts.withColumn("_end", F.least(F.col("_first") + F.col("_n"), F.col("_want"))).where("_first < _end")
    counts = counts.repartition(max(8, -(-slots // slots_a_task)), "_sid", "_shard")  # few rows that stand for many slots
    slot = counts.select("_sid", "_shard", "_blocks", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("_slot"))
    turn = F.floor(F.col("_slot") / F.col("_blocks"))
    return slot.select("_sid", "_shard", "_slot", permuted(F.col("_slot") % F.col("_blocks"), F.col("_blocks"), [F.lit(seed), F.col("_sid"), turn]).alias("_block"))


def mix_plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_slots: int = 1024,
    seed: int = 17, rows_a_task: int = 20_000, keys: tuple[str, ...] = (), ties: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each stretch of a document that lies in one block: ``doc_id, size, source_size, target, start`` (its first
    word's number in the source), ``from_word`` and ``words`` (the stretch, in the document) and ``times`` (how often the
    mix takes it; 0 is kept). A document without words has one row, with 0 words. ``keys`` and ``ties``: columns of ``docs`` to carry;
    where a document comes in its source follows from its id, its size and ``keys``, and from ``ties`` only among equals.
    """
    sized = docs.select("doc_id", "source", *keys, *ties, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut_lineage(sized)  # texts are read once
    sources = cut_lineage(source_targets(sized, weights, share, cap))
    parts = max(8, -(-sized.count() // rows_a_task))
    same = sources.withColumnRenamed("source", "_source")
    sized = sized.join(same, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    sized = sized.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", *keys), F.lit(parts)))
    placed = running_start(sized, ["_sid"], "_part", [F.col(c) for c in ("doc_id", "size", *keys, *ties)], F.col("size"), "start").drop("_part")
    block = lambda c: F.floor(c / block_words)
    within = F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))
    stretches = placed.withColumn("_block", F.explode(F.when(F.col("size") > 0, within).otherwise(F.array(F.lit(-1).cast("long")))))
    left = F.greatest(F.col("start"), F.col("_block") * block_words)
    right = F.least(F.col("start") + F.col("size"), (F.col("_block") + 1) * block_words)
    empty = F.col("_block") < 0
    stretches = stretches.withColumn("from_word", F.when(empty, 0).otherwise(left - F.col("start"))).withColumn("words", F.when(empty, 0).otherwise(right - left))
    times = mix_slots(sources, seed, block_words, shard_slots, cap).groupBy("_sid", "_block").agg(F.count("*").alias("_times"))
    joined = stretches.join(times, ["_sid", "_block"], "left")
    return joined.select("doc_id", *keys, *ties, "size", "source_size", "target", "_sid", "start", "from_word", "words", F.coalesce("_times", F.lit(0)).alias("times"))


def mix_totals(plan: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document."""
    by = ["_sid", "start", "doc_id", "size", "source_size", "target"]
    some = plan.where("size > 0").groupBy(*by).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = plan.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return some.select(*out).unionByName(none.select(*out))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with, for each time the mix goes through a document, a row whose ``text`` is the words it takes then.

    The white space after a word goes with the word, so that a document taken whole has its own text. What the mix does
    not take is left out; a document without words is never taken. A row is known by its file and its place in it, so each
    copy of a repeated row has its own part in the mix, and rows under one id are told apart; a table that is not read from
    files is written once. Where a row comes in the mix follows from its content, wherever its file lies, so reruns agree.
    """
    docs, file, place = numbered(docs)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")  # so that no name of a column clashes with ours
    content = F.xxhash64(F.concat_ws("|", F.hash("doc_id"), F.hash("source"), F.length("source"), F.length("text")), "source", "text")
    keyed = docs.select(own, "doc_id", "source", "text", content.alias("_key"), file.alias("_file"), place.alias("_place"))
    plan = mix_plan(keyed, keys=("_key",), ties=("_file", "_place"), **parameters).where("times > 0")
    taken = plan.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    parts = F.array_sort(F.collect_list(F.struct("from_word", "words")))
    taken = taken.groupBy("_file", "_place", "_turn").agg(parts.alias("_parts"), F.sum("words").alias("_n"), F.first("size").alias("_size"))
    joined, body = keyed.select("_doc", "_file", "_place").join(taken, ["_file", "_place"]), F.col("_doc.text")
    words = F.regexp_extract_all(body, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda w: F.flatten(F.transform("_parts", lambda p: F.slice(w, (p["from_word"] + 1).cast("int"), p["words"].cast("int"))))
    some = F.array_join(F.flatten(F.transform(F.array(words), cut)), "")  # a lambda over one item: the words are found once
    text = F.when(F.col("_n") == F.col("_size"), body).otherwise(some)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
