"""Deduplication. First and last always go by an explicit position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..storage import written
from . import predicates as P
from .topk import duplicates_to_drop


def dedupe_last_value(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row a key: the position of its first row, the values of its last."""
    rest = [c for c in df.columns if c not in (*keys, pos)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_v"), F.min(pos).alias(pos))
    return best.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def merge_hits(hits: DataFrame) -> DataFrame:
    """Search hits merged by organization and canonical URL (without a last slash): the first position, and the first
    title and content that are not blank."""
    some = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("pos"))
    keyed = hits.withColumn("canonical", U.canonical_url(F.col("url"), drop_slash=True)).where("canonical is not null")
    return keyed.groupBy("organization_id", "canonical").agg(
        F.min("pos").alias("pos"), F.coalesce(F.min_by("title", some("title")), F.lit("")).alias("title"), F.coalesce(F.min_by("content", some("content")), F.lit("")).alias("content")
    )


def dedupe_names(df: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """One spelling, the first, for each name."""
    return df.withColumn("_k", T.norm_name(F.col(name))).where("_k <> ''").groupBy("_k").agg(F.min_by(name, pos).alias(name), F.min(pos).alias(pos)).drop("_k")


def dedupe_titles(events: DataFrame, k: int = 10, group: str = "organization_id", fold: int = 1000) -> DataFrame:
    """Greedy by falling score: an event goes if its URL was seen in its organization or its title's key contains or is
    contained in a kept one's; at most ``k`` stay for each organization. An empty key matches nothing.

    Organizations of up to ``fold`` candidates (there are at most 20 in this job, see ``cap_candidates``) are folded in order
    inside one expression; larger ones are decided in rounds by ``_first_independent``, with the same result.
    """
    keyed = events.withColumn("_key", T.title_key(F.col("title"))).withColumn("_url", U.canonical_url(F.col("source_url")))
    keyed = keyed.select(F.col(group).alias("_group"), "id", F.struct((-F.col("relevance_score")).alias("score"), "id").alias("_order"), "_key", "_url")
    large = keyed.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") > fold).select(F.col("_group").alias("_large"))
    if large.isEmpty():
        return events.join(_folded(keyed, k), "id", "left_semi")
    large, same = written(large), F.col("_group").eqNullSafe(F.col("_large"))
    rounds = _first_independent(keyed.join(large, same, "left_semi"), k)
    return events.join(_folded(keyed.join(large, same, "left_anti"), k).unionByName(rounds), "id", "left_semi")


def _folded(keyed: DataFrame, k: int) -> DataFrame:
    """(id) kept of groups whose rows fit into one expression."""
    item = F.struct("_order", "id", F.col("_key").alias("key"), F.col("_url").alias("url"))

    def keep(kept, x):
        same = F.exists(kept, lambda y: F.coalesce(y["url"] == x["url"], F.lit(False)) | ((x["key"] != "") & (y["key"] != "") & (F.contains(y["key"], x["key"]) | F.contains(x["key"], y["key"]))))
        return F.when(same | (F.size(kept) >= k), kept).otherwise(F.concat(kept, F.array(x)))

    listed = keyed.groupBy("_group").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    return listed.select(F.explode(F.aggregate("_all", none, keep)).alias("_k")).select(F.col("_k.id").alias("id"))


def _containments(keys: DataFrame, gram: int = 4) -> DataFrame:
    """(_group, _key, _other) in both directions for every two different keys of a group of which one contains the other.

    Keys meet by the rarest of their grams: it stands in every key that contains them. Of a key shorter than a gram it is the
    key itself. Grams move as hashes with a number for their key; texts are looked up for what meets, and compared as a whole."""
    told, n = written(keys.withColumn("_id", F.monotonically_increasing_id())), F.length("_key")
    overlapping = lambda size: F.array_distinct(F.regexp_extract_all("_key", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
    hashed = lambda number, grams: told.select("_id", "_group", F.explode(grams).alias("_g")).select(F.col("_id").alias(number), F.xxhash64("_group", "_g").alias("_gram"))
    posted = written(hashed("_to", F.array_distinct(F.flatten(F.array(*[overlapping(size) for size in range(1, gram + 1)])))))
    counts = posted.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = hashed("_id", F.when(n < gram, F.array("_key")).otherwise(overlapping(gram)))
    rarest = own.join(counts, "_gram").groupBy("_id").agg(F.min_by("_gram", "_n").alias("_gram"))
    near = rarest.join(posted, "_gram").where("_id <> _to").select("_id", "_to")
    other = told.select(F.col("_id").alias("_to"), F.col("_group").alias("_own"), F.col("_key").alias("_other"))
    both = near.join(other, "_to").join(told, "_id").where((F.col("_group") == F.col("_own")) & F.contains("_other", "_key"))
    met = both.select("_group", "_key", "_other")
    return met.unionByName(met.select("_group", F.col("_other").alias("_key"), F.col("_key").alias("_other")))


def _first_independent(keyed: DataFrame, k: int) -> DataFrame:
    """(id) kept of groups of any size, by rounds: what comes first among all that it conflicts with stays, and what conflicts
    with that goes, until nothing is undecided. Rows of one URL or one key are told by the least of them, never by pairs.
    What comes after the ``k``-th row kept in its group cannot be among the first ``k`` and goes as well, so that few rounds
    are left after the first."""
    present = F.coalesce("_group", F.lit("")), F.col("_group").isNull()
    left = written(keyed.withColumn("_group", F.struct(present[0].alias("g"), present[1].alias("none"))).withColumn("_key", F.coalesce("_key", F.lit(""))))
    keys = left.where("_key <> ''").select("_group", "_key").distinct()
    meet = written(_containments(keys))
    kept = None
    while not left.isEmpty():
        by_key = left.where("_key <> ''").groupBy("_group", "_key").agg(F.min("_order").alias("_first"))
        around = meet.join(by_key.withColumnRenamed("_key", "_other"), ["_group", "_other"]).groupBy("_group", "_key").agg(F.min("_first").alias("_near"))
        by_url = left.where("_url is not null").groupBy("_group", "_url").agg(F.min("_order").alias("_same"))
        told = left.join(by_key, ["_group", "_key"], "left").join(around, ["_group", "_key"], "left").join(by_url, ["_group", "_url"], "left")
        first = lambda c: F.col(c).isNull() | (F.col("_order") <= F.col(c))
        now = written(told.where(first("_first") & first("_same") & first("_near")).select("_group", "id", "_order", "_key", "_url").distinct())
        kept = now if kept is None else kept.unionByName(now)
        place = F.row_number().over(Window.partitionBy("_group").orderBy("_order"))
        last = kept.withColumn("_p", place).where(F.col("_p") <= k).groupBy("_group").agg(F.max("_order").alias("_last"), F.count("*").alias("_n"))
        named = now.where("_key <> ''").select("_group", "_key")
        gone = named.unionByName(named.join(meet, ["_group", "_key"]).select("_group", F.col("_other").alias("_key"))).distinct()
        rest = left.join(now.select("_group", "_order"), ["_group", "_order"], "left_anti").join(gone, ["_group", "_key"], "left_anti")
        rest = rest.join(now.where("_url is not null").select("_group", "_url").distinct(), ["_group", "_url"], "left_anti").join(last, "_group", "left")
        left = written(rest.where(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("_order") < F.col("_last"))).select(*left.columns))
    if kept is None:
        return keyed.select("id").where("false")
    return kept.withColumn("_p", F.row_number().over(Window.partitionBy("_group").orderBy("_order"))).where(F.col("_p") <= k).select("id")


def distinct_ordered(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Candidates of several sources in the order of the sources."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_rank", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stored_candidates(df: DataFrame, k: int = 5, longest: int = 500) -> DataFrame:
    """What is stored of an entity's candidates: valid URLs once, the official one first, scores within 0 and 100."""
    url = U.canonical_url(F.col("url"), force_https=True)
    good = df.withColumn("url", url).where("url is not null").where(~P.is_rejected_url(F.col("url")))
    once = good.groupBy("entity_id", "url").agg(F.max("is_official").alias("is_official"), F.min("pos").alias("pos"), F.max(F.least(F.greatest("score", F.lit(0)), F.lit(100))).alias("score"), F.min_by("title", "pos").alias("title"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("is_official"), "pos", "url"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).withColumn("title", F.substring("title", 1, longest))


def plan_org_cleanup(orgs: DataFrame, events: DataFrame) -> DataFrame:
    """(entity_id, name, rule): invalid names, then empty shells, then repeated names among the rest."""
    rows = orgs.select("entity_id", "name", "description", "website_url")
    invalid = rows.where(P.is_invalid_name(F.col("name")))
    shells = P.empty_shells(rows, events).join(invalid.select("entity_id"), "entity_id", "left_anti")
    left = rows.join(invalid.select("entity_id").union(shells.select("entity_id")), "entity_id", "left_anti")
    named = lambda df, rule: df.select("entity_id", "name", F.lit(rule).alias("rule"))
    return named(invalid, "invalid").union(named(shells, "shell")).union(named(duplicates_to_drop(left), "duplicate"))
