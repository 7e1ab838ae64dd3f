"""The pipeline stage by stage against brute force, on a whole small table and on rows of every awkward kind."""

import collections
import re

import pytest
import regex
from test_llm import ODD, ODD_SCHEMA, SF, W, brute_links, brute_quality, check_packing, targets

import corpus_pipeline
from orgwatch.llm import pii

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage got and gave."""
    at, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        stage(spark, docs, SF).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out[name] = given, docs.collect()
    return out


def test_quality_stage(stages, spark):
    given, got = stages["quality_rules"]
    assert got[0].__fields__ == given[0].__fields__ == corpus_pipeline.COLUMNS
    left, labels = collections.Counter(got), {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not left - collections.Counter(given)
    for r in given:
        n_words, *_, repeated = brute_quality(r.text)
        if n_words < 50 or 2 * repeated > n_words:
            assert not left[r]
    good = [r for r in given if r.doc_id in labels and labels[r.doc_id].quality == 1 and brute_quality(r.text)[0] >= 50]
    assert sum(left[r] > 0 for r in good) >= 0.95 * len(good)


def test_near_duplicates_stage(stages):
    given, got = stages["near_duplicates"]
    given = sorted(given, key=lambda r: r.doc_id)
    _, least = brute_links([r.text for r in given])
    assert sorted(r.doc_id for r in got) == [given[i].doc_id for i in sorted(set(least))]
    assert not collections.Counter(got) - collections.Counter(given)


def test_personal_data_stage(stages):
    given, got = stages["personal_data"]
    pattern, new = regex.compile(pii.PATTERN), {r.doc_id: r for r in got}
    assert len(given) == len(got)
    for r in given:
        text = new[r.doc_id].text
        assert pattern.split(r.text) == pattern.split(text) and new[r.doc_id].n_chars == len(text)
        assert all(a != b for a, b in zip(pattern.findall(r.text), pattern.findall(text)) if not re.fullmatch(r"[\d -]{13,}|[\d.]+", a))


def test_mixing_stage(stages):
    given, got = stages["mixing"]
    words = lambda t: collections.Counter(W.findall(t))
    texts, sizes, taken, times = {r.doc_id: r for r in given}, collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for r in given:
        sizes[r.source] += len(W.findall(r.text))
    for r in got:
        assert not words(r.text) - words(texts[r.doc_id].text) and r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
        taken[r.source] += len(W.findall(r.text))
        times[r.doc_id].update(words(r.text))
    assert all(n <= 2 * words(texts[k].text)[w] for k, c in times.items() for w, n in c.items())
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 3 * 64) for s in want)


def test_packing_stage(stages):
    given, got = stages["packing"]
    once = {k for k, n in collections.Counter(r.doc_id for r in given).items() if n == 1}
    check_packing(got, {r.doc_id: r.text for r in given if r.doc_id in once})
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_whole_run_agrees(stages, spark):
    """A run from the start gives the rows that the stages gave one by one."""
    assert collections.Counter(corpus_pipeline.run(spark, SF).collect()) == collections.Counter(stages["packing"][1])


def test_odd_rows(spark, tmp_path):
    rows = [(*r[:4], None if r[1] is None else len(r[1]), r[4]) for r in ODD]
    prose = "The river ran past the old mill while every child of the village watched the boats and waited for word {}. " * 1
    long = " ".join(prose.format(f"from {i}") for i in range(40))
    rows += [(20, long, "en", "a", 1, "x"), (20, long, "en", "a", 1, "x"), (21, long + " And so it went.", None, None, 1, None), (None, long, "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, ODD_SCHEMA.replace("_n string", "n_chars long, _n string"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        alone = stage(spark, docs.withColumnRenamed("_n", "_h1"), SF).collect()  # every stage on the odd rows themselves
        if name == "personal_data":
            assert len(alone) == len(rows)
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in alone) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 20]))
        if name == "packing":
            assert len({(r.doc_id, r.doc_tokens) for r in alone}) >= 9
        nothing = stage(spark, docs.where("false"), SF)
        assert nothing.count() == 0 and (k == 4 or nothing.columns == corpus_pipeline.COLUMNS)


def test_small_batches_restores_the_session(spark):
    from orgwatch.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, inside in (("10000", "1000"), ("50", "50"), ("0", "1000")):
            spark.conf.set(key, given)
            with small_batches(spark):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == given
    finally:
        spark.conf.set(key, before)


def test_run_leaves_the_last_written_stage_alone(spark, stages):
    """The whole run gives what the stages give one by one, and keeps no more than the stage that the last one reads."""
    from pathlib import Path

    before = set(Path(corpus_pipeline.shared_dir(spark).removeprefix("file:")).glob("corpus-*"))
    rows = corpus_pipeline.run(spark, SF).collect()
    new = set(Path(corpus_pipeline.shared_dir(spark).removeprefix("file:")).glob("corpus-*")) - before
    assert [p.name for f in new for p in f.iterdir()] == ["mixing"]
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted((r.doc_id, r.start, r.length) for r in stages["packing"][1])
