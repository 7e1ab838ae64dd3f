"""What moves between tasks, and what a task holds, on larger tables."""

import json
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orgwatch import catalog
from orgwatch import demo as V
from orgwatch.functions import normalize as N
from orgwatch.llm import ann
from orgwatch.operators import dedup, model_io
from orgwatch.plans import audit

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_organizations_are_not_shuffled(spark):
    """Texts that no organization has go where they are read, also where documents are too large to be sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plan = _plan(V.orgs(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (semi,) = [line for line in plan.split("\n") if "LeftSemi" in line]
    assert "BroadcastHashJoin" in semi


def test_lookup_joins_the_newest_events_alone(spark):
    """An organization of 5,000 events gives each question its newest ones, which are chosen before the join."""
    orgs = spark.createDataFrame([(f"o{i}", f"Lab {i} of Things") for i in range(30)], "entity_id string, name string")
    events = spark.range(5000).select(F.col("id"), F.concat(F.lit("o"), F.col("id") % 1).alias("organization_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("2024-01-01").alias("event_date"), F.lpad(F.col("id").cast("string"), 6, "0").alias("created_at"))
    asked = spark.createDataFrame([("of Things",), ("Lab 7",), ("Lab 0 of",)], "query string")
    found = audit.lookup_institutions(orgs, events, asked)
    plan = _plan(found)
    assert "WindowGroupLimit" in plan[plan.index("LeftOuter") :]
    got = {(r.query, r.place): (r.entity_id, r.event_titles) for r in found.collect()}
    newest = ["t4999", "t4998", "t4997"]
    assert got == {("of Things", 1): ("o0", newest), ("Lab 7", 1): ("o7", []), ("Lab 0 of", 1): ("o0", newest)}
    every = audit.lookup_institutions(orgs, events, asked, complete=True).where("query = 'of Things'").collect()
    assert sorted((r.place, r.entity_id) for r in every) == [(1, "o0"), (2, "o1"), (3, "o10")]


def test_decomposition_without_python(spark):
    """Whole texts never go to Python, and come out as Unicode's data has it."""
    texts = [chr(i) for i in (*range(0x80, 0x250), *range(0x1E00, 0x2000), 0xFB01, 0xFF21, 0xAC00)] + ["Ébauche ﬁn ½ 한글 Å", "<b>Ünï</b> plain", "plain", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    made = df.select("i", N.nfkd(F.col("t")).alias("n"), N.norm_letters(F.col("t")).alias("l"), N.slug(F.col("t")).alias("s"))
    assert "Python" not in _plan(made)
    got = {r.i: r for r in made.collect()}
    for i, t in enumerate(texts):
        if t is not None and unicodedata.category(t[:1] or "x") != "Cn":
            assert got[i].n == "".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x)[0] != "M")
    assert (got[len(texts) - 4].l, got[len(texts) - 5].s, got[len(texts) - 1].n) == ("uni plain", "ebauche-fin-1-2-a", None)


@pytest.mark.parametrize("name", ["f3_norm_ascii_han", "f4_norm_letters", "f8_slug"])
def test_queries_of_whole_texts_stay_where_they_read(spark, name):
    """The queries that decompose whole texts read and map: nothing goes to Python, and nothing moves between tasks."""
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in plan and "Exchange" not in plan


def test_answers_are_read_once_and_given_on_in_parts(spark, monkeypatch):
    """An answer that holds as a whole is parsed once, and its items leave in parts."""
    items = [{"title": f"t{i}", "summary": "s", "url": "https://a.org/[1]", "relevance_score": 5} for i in range(2500)]
    parts = list(model_io._item_rows(iter([pa.record_batch({"organization_id": ["a", "b", "c"], "response": [json.dumps(items), None, json.dumps(items[:1])]})])))
    assert [p.num_rows for p in parts] == [1000, 1000, 500, 1] and parts[2].column("item_no").to_pylist() == list(range(2000, 2500))
    answers = spark.createDataFrame([(7, "see " + json.dumps(items)), (8, "none")], "organization_id long, response string")
    got = model_io.parse_event_responses(answers)
    assert got.columns == ["organization_id", "level", "item_no", "title", "summary", "url", "event_date", "event_type", "relevance_score"]
    assert sorted((r.organization_id, r.level, r.item_no, r.title) for r in got.collect()) == [(7, "cleaned", i, f"t{i}") for i in range(2500)]
    calls, loads = [], json.loads
    monkeypatch.setattr(model_io.json, "loads", lambda t: calls.append(t) or loads(t))
    assert model_io._parse(json.dumps(items))["level"] == "direct" and len(calls) == 1


@pytest.mark.parametrize("shape", ["{}", '{{"candidates": {}}}', "so:\n```json\n{}\n```", "I found {} in all.", "repaired {}"])
def test_long_answers_are_read_item_by_item(shape):
    """Beside copies of an answer's text, memory does not grow with its items."""
    items = [{"title": f"t{i} [x]", "summary": "s", "url": "https://a.org/", "relevance_score": 5, "event_date": None, "event_type": "report"} for i in range(30_000)]
    text = shape.format(json.dumps(items))
    if shape.startswith("repaired"):
        text = text[:-1] + ",]"
    batch = pa.record_batch({"organization_id": ["a"], "response": [text]})
    tracemalloc.start()
    n = sum(p.num_rows for p in model_io._item_rows(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(items)
    assert peak < 4 * len(text) + 4_000_000
    level, read = model_io._read(text)
    whole = model_io._parse(text)
    assert list(read) == whole["items"] and level == whole["level"]


def test_read_as_parsed_whole():
    """Odd answers come out one by one as they do when they are parsed as a whole; a score that is no number fails them."""
    item = {"title": "T", "summary": "S", "url": "https://a.org/x", "relevance_score": 7}
    j = json.dumps([item, item])
    odd = ["[]", '"[]"', "[,]", j + "x", j[:-1] + ",]", f'{{"candidates":{j},"candidates":[]}}', f'{{"candidates":{j}', f'{{"a":1,"candidates":{j}}}', json.dumps(j), json.dumps(item), f'```{{"candidates":{j}}}```', f"[1] {j}", None, " "]
    odd += [f'[{json.dumps(item)}, {json.dumps(item).replace("7", x)}]' for x in ("NaN", "Infinity", "1e999", "7.0", "true")]
    for text in odd:
        whole, (level, read) = model_io._parse(text), model_io._read(text)
        read = list(read)
        assert read == (whole["items"] or []) and (not read or level == whole["level"]), text
    assert [model_io._parse(t)["level"] for t in odd[-5:-2]] == ["failed"] * 3


def test_answers_do_not_grow_with_an_organization(spark, tmp_path):
    """One organization with 5,000 events has several answers, with each event in one of them."""
    ids = spark.range(5000)
    ids.select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/"), "id").alias("url"), F.lit("<title>t</title><p>s</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    ids.select(F.col("id").alias("event_id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    sizes = [r.n for r in catalog._answers(spark, str(tmp_path)).select((F.size(F.split("response", '"title"')) - 1).alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1000
    assert catalog.QUERIES["l2_parse_responses"](spark, str(tmp_path)).distinct().count() == 5000


def test_grams_move_without_texts(spark, monkeypatch):
    """What is written for each gram of a key are numbers; what contains what is as by comparing all keys."""
    seen, real = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df: seen.append(df.schema) or real(df))
    texts = ["a", "ab", "abcd", "xabcdx", "bcd", "zzz", "zz", "abcde", "Ünï"]
    keys = spark.createDataFrame([(g, t) for g in ("o", "p") for t in texts if g == "o" or len(t) > 2], "g string, _key string").select(F.struct("g", F.lit(False).alias("none")).alias("_group"), "_key")
    got = [(r._group.g, r._key, r._other) for r in dedup._containments(keys).collect()]
    rows = [(r._group.g, r._key) for r in keys.collect()]
    assert sorted(set(got)) == sorted((g, a, b) for g, a in rows for h, b in rows if g == h and a != b and (a in b or b in a))
    posted = [s for s in seen if "_gram" in s.names]
    assert posted and all(f.dataType.typeName() == "long" for s in posted for f in s)


def _sent(plan: str) -> list[str]:
    """What a plan sends to all tasks through the driver: the lines below each broadcast."""
    lines, found = plan.split("\n"), []
    for i, line in enumerate(lines):
        at = line.find("BroadcastExchange")
        below = next((j for j in range(i + 1, len(lines)) if re.search(r"[A-Z*]", lines[j]) is None or re.search(r"[A-Z*]", lines[j]).start() <= at), len(lines))
        found += ["\n".join(lines[i:below])] if at >= 0 else []
    return found


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Visits are made of few queries, so that Spark takes them for small; each query makes hundreds of them here."""
    x = np.random.default_rng(9).normal(size=(400, 32))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    plans, write = [], ann.cut_lineage
    monkeypatch.setattr(ann, "cut_lineage", lambda df: (plans.append(_plan(df)), write(df))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 40 = 0"), bucket_rows=len(rows) / 2**12.8)
    sent = [below for plan in [*plans, _plan(got)] for below in _sent(plan)]
    assert sent and not [below for below in sent if "MapInPandas" in below or "vector" in below]  # what is sent are numbers
    unit = ann._unit(x)
    found = {q: set() for q in range(0, 400, 40)}
    for r in got.collect():
        found[r.query_id].add(r.vec_id)
    assert sum(len(found[q] & (set(np.argsort(-unit @ unit[q])[:6].tolist()) - {q})) for q in found) >= 0.9 * 5 * len(found)
