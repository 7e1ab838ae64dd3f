"""Many patterns at once, lookups by question, compiled rules."""

import random

import pytest
from pyspark.sql import functions as F

from orgwatch.operators.patterns import find_patterns
from orgwatch.plans import audit


@pytest.mark.parametrize("most", [20, 4_000_000])
def test_find_patterns(spark, most):
    """Overlapping, nested, repeated and absent patterns, null and empty texts, in one block and in many."""
    draw = random.Random(most)
    texts = ["".join(draw.choice("abc😀") for _ in range(draw.randint(0, 30))) for _ in range(200)]
    patterns = ["a", "ab", "abc", "bca", "😀a", "aaaa", "", None, "a", "zz"] + ["".join(draw.choice("abc") for _ in range(4)) for _ in range(20)]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "x")], "i long, t string, p string")
    asked = spark.createDataFrame([(p,) for p in patterns], "q string")
    got = find_patterns(rows, "t", asked, "q", most)
    assert got.columns == ["i", "p", "q"]
    assert sorted((r.i, r.q) for r in got.collect()) == sorted((i, p) for i, t in enumerate(texts) for p in {p for p in patterns if p} if p in t)
    assert find_patterns(rows, "t", asked.where("false"), "q").count() == 0 and find_patterns(rows.where("false"), "t", asked, "q").count() == 0


def test_lookup_of_a_very_long_text(spark):
    """A description of 200,000 words meets 2,000 questions without a row for each stretch of it."""
    words = [f"word{i}" for i in range(200_000)]
    orgs = spark.createDataFrame([("o1", "One", " ".join(words)), ("o2", "Two", None), ("o3", "Three", "WORD77 word78")], "entity_id string, name string, description string")
    events = spark.createDataFrame([], "organization_id string, id long, title string, event_date string, created_at string")
    asked = spark.createDataFrame([(f"word{i} word{i + 1}",) for i in range(0, 2000)] + [("nothing like it",), (" ?! ",), (None,)], "query string")
    got = audit.lookup_institutions(orgs, events, asked).collect()
    assert len(got) == 2001 and {r.entity_id for r in got if r.query == "word77 word78"} == {"o1", "o3"} and all(r.event_titles == [] for r in got)


def test_catalog_rules_are_an_expression(spark):
    df = spark.createDataFrame([("Alpha 12", "lab", "DE", "EU", "sure"), (None, None, None, "", "needs_review"), ("beta", "odd", "DE", "EU", "sure")], "name string, entity_type string, country string, region string, location_confidence string")
    rules = [("[0-9]", 1, 2), ("^b", None, None), (None, 1, 1), ("[0-9]", 1, 3)]
    table = spark.createDataFrame(rules, "pattern string, min_chars int, min_words int")
    got = audit.catalog_violations(df, table, ["lab"], ["none"])
    want = [("Alpha 12", "pattern [0-9]"), ("None", "country"), ("None", "location"), ("None", "region"), ("None", "type"), ("beta", "pattern ^b"), ("beta", "type")]
    assert sorted((str(r.name), r.violation) for r in got.collect()) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        audit.catalog_violations(df, table, ["lab"], [], most_rules=3)
    assert audit.catalog_violations(df.where("false"), table.where(F.lit(False)), [], []).count() == 0
