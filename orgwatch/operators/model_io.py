"""What goes to an external model step and what comes back: requests, answers, validation, filters.

The model step itself is the user's: ``score_with`` runs a function over batches of requests.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import text as X
from ..functions import urls as U

#: Fixed values.
EVENT_TYPES = ["report", "partnership", "personnel", "policy", "research", "award", "other"]
KEYS = {"title", "summary", "url", "relevanceScore", "relevance_score", "eventDate", "event_date", "eventType", "event_type"}
GARBAGE = "登录|注冊|注册|广告|cookie|404"

ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "summary", "url", "event_date", "event_type")] + [T.StructField("relevance_score", T.IntegerType())]
)
PARSED = T.StructType([T.StructField("items", T.ArrayType(ITEM)), T.StructField("level", T.StringType())])


def build_event_requests(candidates: DataFrame) -> DataFrame:
    """(organization_id, request): one JSON text for each organization, candidates in order, contents marked by how they were
    extracted."""
    marker = F.when(F.col("extraction_method") == "full-text", "[FULL TEXT] ").otherwise("[SNIPPET MODE - LIMITED INFO] ")
    content = F.concat(marker, F.coalesce("llm_context", "summary", F.lit("")))
    item = F.struct("pos", "title", "url", content.alias("content"))
    listed = F.array_sort(F.collect_list(item))
    return candidates.groupBy("organization_id").agg(F.to_json(F.struct(F.transform(listed, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["content"].alias("content"))).alias("candidates"))).alias("request"))


def score_with(requests: DataFrame, step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run the user's model step over batches of requests."""
    return requests.mapInPandas(step, schema)


_LOOSE_COMMA = re.compile(r",\s*([\]}])")
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)


def _arrays(text: str) -> Iterator[str]:
    """Bracketed parts of a text that might be JSON arrays, by where they begin. One pass finds the end of each: brackets
    with equally many quotes before them, even or odd, are matched among themselves."""
    open_, ends, quoted = ([], []), {}, 0
    for m in re.finditer(r'\\.|["\[\]]', text, re.S):
        if m[0] == '"':
            quoted ^= 1
        elif m[0] == "[":
            open_[quoted].append(m.start())
        elif m[0] == "]" and open_[quoted]:
            ends[open_[quoted].pop()] = m.end()
    for at in sorted(ends):
        yield text[at : ends[at]]


def _item(x: object) -> dict | None:
    """An item in our columns, if it holds to the schema."""
    if not isinstance(x, dict) or set(x) - KEYS or ("relevanceScore" in x) == ("relevance_score" in x):
        return None
    if ("eventDate" in x and "event_date" in x) or ("eventType" in x and "event_type" in x):
        return None
    score, date, kind = (x.get(a, x.get(b)) for a, b in (("relevanceScore", "relevance_score"), ("eventDate", "event_date"), ("eventType", "event_type")))
    told = [x.get(k) for k in ("title", "summary", "url")]
    texts = all(isinstance(t, str) and t.strip() for t in told) and re.match(r"\s*https?://[^/\s]", told[2], re.I)
    whole = isinstance(score, (int, float)) and not isinstance(score, bool) and 1 <= score <= 10 and score == int(score)
    if not texts or not whole or not (date is None or isinstance(date, str)) or not (kind is None or (isinstance(kind, str) and kind.strip())):
        return None
    return {"title": told[0], "summary": told[1], "url": told[2], "event_date": date, "event_type": kind, "relevance_score": int(score)}


def _valid(items: object) -> list[dict] | None:
    """The items, in our columns, of a list in which every item holds to the schema; else None."""
    if not isinstance(items, list):
        return None
    out = []
    for x in items:
        if (good := _item(x)) is None:
            return None
        out.append(good)
    return out


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


_OPENED = re.compile(r'[ \t\n\r]*(\{[ \t\n\r]*"candidates"[ \t\n\r]*:[ \t\n\r]*)?\[[ \t\n\r]*')
_COMMA = re.compile(r"[ \t\n\r]*,[ \t\n\r]*")
_CLOSED = re.compile(r"[ \t\n\r]*\][ \t\n\r]*(\}[ \t\n\r]*)?\Z")


def _one_by_one(text: str) -> Iterator[dict]:
    """The items, in our columns, of a JSON array or of an object of nothing but candidates, of which one is held at a time;
    ValueError where the text is neither or an item does not hold to the schema."""
    begin, decode = _OPENED.match(text), json.JSONDecoder().raw_decode
    closed = lambda: (end := _CLOSED.match(text, at)) and bool(end[1]) == bool(begin[1])
    at = begin.end() if begin else 0
    if begin and closed():
        return
    while begin:
        x, at = decode(text, at)
        if (good := _item(x)) is None:
            break
        yield good
        if closed():
            return
        if not (comma := _COMMA.match(text, at)):
            break
        at = comma.end()
    raise ValueError("no list of items")


def _unheld(text: str) -> object:
    """As ``_load``, but where the items can be had one by one, a function that does so, after a pass that holds none of them."""
    try:
        for _ in _one_by_one(text):
            pass
        return partial(_one_by_one, text)
    except (ValueError, RecursionError):
        begin = _OPENED.match(text)
        return None if begin and not begin[1] else _load(text)


def _tries(text: str, load: Callable[[str], object]) -> Iterator[tuple[str, object]]:
    """(level, what may be the items), each read only where those before it do not hold."""
    whole = load(text) if text else None
    if isinstance(whole, str) and whole.strip()[:1] in ("{", "["):
        whole = load(whole) or whole
    if isinstance(whole, dict):
        whole = whole["candidates"] if isinstance(whole.get("candidates"), list) else [whole]
    yield "direct", whole
    if fence := _FENCE.search(text):
        yield "markdown", load(fence[1])
    for part in _arrays(text):
        yield "cleaned", load(part)
        yield "repaired", load(_LOOSE_COMMA.sub(r"\1", part))


def _parse(answer: str | None) -> dict:
    text = (answer or "").strip()
    for level, items in _tries(text, _load):
        good = _valid(items)
        if good is not None:
            return {"items": good, "level": level}
    return {"items": None, "level": "failed" if text else "empty"}


def _read(answer: str | None) -> tuple[str | None, Iterator[dict]]:
    """As ``_parse``, with the items one by one, for answers of any length."""
    for level, items in _tries((answer or "").strip(), _unheld):
        # An object in a fence or in brackets is no list, with or without candidates.
        if isinstance(items, partial):
            if level == "direct" or not _OPENED.match(items.args[0])[1]:
                return level, items()
        elif (good := _valid(items)) is not None:
            return level, iter(good)
    return None, iter(())


@F.pandas_udf(PARSED)
def parse_event_response(answers: pd.Series) -> pd.DataFrame:
    """(items, level) of each answer: plain JSON, JSON in a string, a wrapper or one object, a fenced block, an array inside
    prose, with loose commas repaired; items null where no level gives a list that holds to the schema as a whole."""
    return pd.DataFrame([_parse(a) for a in answers], columns=["items", "level"])


def parse_event_responses(answers: DataFrame) -> DataFrame:
    """``answers`` (organization_id, response): a row for each item, with the level at which the answer could be read. A task
    holds the text of an answer, reads its items one by one and gives them on in parts."""
    schema = T.StructType([answers.schema["organization_id"], T.StructField("level", T.StringType()), T.StructField("item_no", T.IntegerType()), *ITEM.fields])
    return answers.select("organization_id", "response").mapInArrow(_item_rows, schema)


def _item_rows(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``most`` items. A part takes in the next answer while it is not half full, so that short ones share."""

    def part(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        places, levels, numbers, items = zip(*rows)
        owner = batch.column(0).take(pa.array(places, pa.int64()))
        columns = [pa.array([x[f.name] for x in items], pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in ITEM]
        return pa.RecordBatch.from_arrays([owner, pa.array(levels, pa.string()), pa.array(numbers, pa.int32()), *columns], names=[batch.schema.names[0], "level", "item_no", *ITEM.names])

    for batch in batches:
        rows = []
        for at in range(batch.num_rows):
            level, items = _read(batch.column(1)[at].as_py())
            for number, x in enumerate(items):
                rows.append((at, level, number, x))
                if len(rows) == most:
                    yield part(batch, rows)
                    rows = []
            if 2 * len(rows) >= most:
                yield part(batch, rows)
                rows = []
        if rows:
            yield part(batch, rows)


def score_filter(items: DataFrame, candidates: DataFrame, today: str, days: int = 30, least: int = 4) -> DataFrame:
    """Items about supplied candidates, without garbage words, scored at least ``least``, with a date within the last ``days``
    or none that can be read; unknown types become ``other``."""
    from .joins import join_llm_items

    date = F.try_to_timestamp(F.substring("event_date", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    clean = ~F.concat_ws(" ", "title", "summary").rlike(f"(?i){GARBAGE}")
    recent = date.isNull() | (date >= F.date_sub(F.lit(today).cast("date"), days))
    kind = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise("other")
    return join_llm_items(items, candidates).where(clean & recent & (F.col("relevance_score") >= least)).withColumn("event_type", kind)


def parse_verdict(c: Column) -> Column:
    """(status, name, reason) of a name check; null where the answer is none, or a correction's name is not of 2 to 200
    characters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```json\s*", ""), r"\s*```$", "")
    v = F.from_json(bare, "status string, name string, reason string")
    name = X.collapse_ws(F.coalesce(v["name"], F.lit("")))
    good = v["status"].isin("VALID", "INVALID") | ((v["status"] == "CORRECTED") & F.length(name).between(2, 200))
    return F.when(good, F.struct(v["status"].alias("status"), F.nullif(name, F.lit("")).alias("name"), v["reason"].alias("reason")))


def parse_translation(c: Column, title: Column, description: Column) -> Column:
    """(title, description) of a translation, each with its own text to fall back on."""
    t, d = (X.collapse_ws(F.coalesce(F.get_json_object(c, f"$.{k}"), F.lit(""))) for k in ("title", "description"))
    return F.struct(F.when(t != "", t).otherwise(title).alias("title"), F.when(d != "", d).otherwise(description).alias("description"))


def request_candidates(hits: DataFrame, articles: DataFrame, orgs: DataFrame, longest: int = 6000, least_body: int = 160) -> DataFrame:
    """Candidates for requests: hits once by canonical URL, capped for each organization, with the body of their article where
    it has one, else as a snippet if the snippet is good enough."""
    from ..plans.cleaning import context_body
    from .dedup import dedupe_last_value
    from .predicates import snippet_quality
    from .topk import cap_candidates

    once = dedupe_last_value(hits.withColumn("url", U.canonical_url(F.col("url"))).where("url is not null"), ["organization_id", "url"])
    capped = cap_candidates(once.join(orgs.select(F.col("entity_id").alias("organization_id"), "website_url"), "organization_id", "left"))
    texts = F.array_join(F.transform(F.filter("contents", lambda x: x["type"] == "text"), lambda x: x["content"]), "\n")
    bodies = articles.select(U.canonical_url(F.col("url")).alias("url"), context_body(texts, longest).alias("_body")).where(F.length("_body") >= least_body).groupBy("url").agg(F.min("_body").alias("_body"))
    joined = capped.join(bodies, "url", "left")
    full = F.col("_body").isNotNull()
    made = joined.withColumn("extraction_method", F.when(full, "full-text").otherwise("snippet-fallback")).withColumn("llm_context", F.coalesce("_body", "summary"))
    return made.where(full | (snippet_quality(X.collapse_ws(F.coalesce("summary", F.lit("")))) == "ok")).drop("_body")


def ingest_events(items: DataFrame, candidates: DataFrame, stored: DataFrame, today: str, days: int = 30, least: int = 4, k: int = 10) -> DataFrame:
    """Stored events plus the new ones out of validated items: filtered, titles deduplicated, unknown URLs only."""
    from .dedup import dedupe_titles
    from .joins import fresh_events

    good = score_filter(items, candidates, today, days, least).withColumn("source_url", U.canonical_url(F.col("url")))
    named = good.withColumn("id", F.sha2(F.concat_ws("|", "organization_id", "source_url"), 256)).withColumn("event_date", F.coalesce(D.valid_event_date(F.col("event_date")), F.lit("unknown")))
    new = fresh_events(dedupe_titles(named.dropDuplicates(["id"]), k), stored)
    return stored.unionByName(new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True)
