"""Small cases with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from orgwatch.functions import dates as D
from orgwatch.functions import text as T
from orgwatch.functions import urls as U
from orgwatch.operators import dedup, joins, predicates as P, views, writes
from orgwatch.plans import cleaning
from orgwatch.streaming import health


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [("https://www.example.edu/research", "example.edu"), ("play.google.com", None), ("https://jingyan.baidu.com/x", None), ("example", None), ("", None), ("ftp://a.org", None), ("a.b.museum", "a.b.museum")],
)
def test_official_domain(spark, url, want):
    assert value(spark, U.official_domain, url) == want


@pytest.mark.parametrize("url, want", [("www.techstars.com", "techstars.com"), ("news.example.co.uk", "example.co.uk"), ("https://a.b.c.org/x?y", "c.org")])
def test_site_key(spark, url, want):
    assert value(spark, U.site_key, url) == want


@pytest.mark.parametrize(
    "url, want",
    [("HTTP://WWW.Example.com:80#x", "http://www.example.com/"), ("https://a.org:8443/p?q#f", "https://a.org:8443/p?q"), ("mailto:x@y", None), ("https://a_b.org/ö x", "https://a_b.org/ö x"), ("nothing", None)],
)
def test_canonical_url(spark, url, want):
    assert value(spark, U.canonical_url, url) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://127.0.0.1/", "private_address"), ("http://10.1.2.3", "private_address"), ("http://192.168.0.1/x", "private_address"), ("http://169.254.169.254/latest", "private_address"),
        ("http://[::1]/", "private_address"), ("file:///etc/passwd", "unsupported_protocol"), ("https://u:p@a.org", "credentials_not_allowed"), ("https://example.com/news", "ok"), ("what", "invalid_url"),
    ],
)
def test_url_safety(spark, url, want):
    assert value(spark, U.url_safety, url) == want


@pytest.mark.parametrize("text, want", [("0099-12-31", None), ("unknown", None), ("2026-08-20", "2026-08-20"), ("2026-02-30", None), ("2026-08-20T10:00:00Z", "2026-08-20T10:00:00Z")])
def test_valid_event_date(spark, text, want):
    assert value(spark, D.valid_event_date, text) == want


@pytest.mark.parametrize("text, want", [("on 2024-13-31", "2025-01-31"), ("2024.2.30", "2024-03-01"), ("none", "unknown"), ("2023/1/2", "2023-01-02")])
def test_event_date_from(spark, text, want):
    assert value(spark, lambda c: D.event_date_from(c, F.lit("")), text) == want


@pytest.mark.parametrize(
    "text, want",
    [('{"title": "A", "description": "B"}', "A"), ('{"title": "A"} and more', "A"), ('{"title": "A", "x": ) broken', "A"), ("plain", "plain"), ("  ", "none"), ('{"x": 1}', "none")],
)
def test_structured_field(spark, text, want):
    assert value(spark, lambda c: views.structured_field(c, "title", F.lit("none")), text) == want


def test_literal_search(spark):
    df = spark.createDataFrame([("100% Research",), ("1000 Research",)], "name string")
    assert [r.name for r in P.search_orgs(df, "100%").collect()] == ["100% Research"]
    assert P.search_orgs(df, " ").count() == 2


def test_health(spark):
    df = spark.createDataFrame([(429, None), (404, None), (None, "ETIMEDOUT"), (200, None), (403, None)], "s int, e string")
    assert [r[0] for r in df.select(health.health_class(F.col("s"), F.col("e"))["retry_class"]).collect()] == ["backoff", "reprobe", "retry", "retry", "manual"]
    at = datetime.datetime(2026, 8, 5, 12)
    log = spark.createDataFrame([(1, i, at, s, None) for i, s in enumerate((403, 404, 429, 500))], "fetch_id int, source_id int, ts timestamp_ntz, status int, error_code string")
    got = {r.source_id: (r.next_check_at, r.next_retry_at) for r in health.source_state(log).collect()}
    hours = lambda h: at + datetime.timedelta(hours=h)
    assert got == {0: (datetime.datetime(9999, 12, 31), None), 1: (hours(168), hours(168)), 2: (hours(2), hours(2)), 3: (hours(1), hours(1))}


def test_admission(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [("a", at + datetime.timedelta(seconds=i)) for i in range(6)] + [("b", at)] + [("a", at + datetime.timedelta(seconds=61))]
    got = health.admit(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "k", "ts", 5, 60).collect()
    assert [r.ts.second for r in got if not r.admitted] == [5]


def test_source_state_stream_replay(spark, tmp_path):
    schema = "fetch_id int, source_id int, ts timestamp_ntz, status int, error_code string"
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, i % 3, at + datetime.timedelta(minutes=i), 200 if i % 2 else 500, None) for i in range(12)]
    for part in range(2):
        spark.createDataFrame(rows[part * 6 : part * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = health.source_state_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.source_id: (r.last.fetch_id, r.failure_count, r.success_count) for r in health.read_source_state(spark, str(tmp_path / "state")).collect()}
    want = {r.source_id: (r.failure_count, r.success_count) for r in health.source_state(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[1:] for k, v in got.items()} == want and {k: v[0] for k, v in got.items()} == {0: 9, 1: 10, 2: 11}


def test_merge_hits(spark):
    rows = [("o", 1, "https://a.org/x", "", "text"), ("o", 2, "https://a.org/x/", "Title", ""), ("o", 3, "https://b.org", "B", "b"), ("o", 4, "nothing", "C", "c")]
    got = dedup.merge_hits(spark.createDataFrame(rows, "organization_id string, pos int, url string, title string, content string")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.content) for r in got] == [(1, "Title", "text"), (3, "B", "b")]


def test_dedupe_titles(spark):
    rows = [
        ("1", "o", "Lab opens", "https://a.org/1", 9), ("2", "o", "New Lab Opens Today", "https://a.org/2", 8), ("3", "o", "Other", "https://a.org/1#x", 7),
        ("4", "o", "!!", "https://a.org/4", 6), ("5", "o", "Prize", None, 5), ("6", "p", "Lab opens", "https://a.org/1", 1),
    ]
    df = spark.createDataFrame(rows, "id string, organization_id string, title string, source_url string, relevance_score int")
    assert sorted(r.id for r in dedup.dedupe_titles(df).collect()) == ["1", "4", "5", "6"]
    assert sorted(r.id for r in dedup.dedupe_titles(df, k=1).collect()) == ["1", "6"]


def test_insert_ignore_keeps_null_keys(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2, 1), ("b", 3, 2), ("b", 4, 3), (None, 5, 4), (None, 6, 5)], "k string, v int, pos int")
    assert sorted(r.v for r in writes.insert_ignore(t, new, ["k"]).collect()) == [1, 3, 5, 6]


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([("a", 1, 1)], "k string, v int, w int")
    new = spark.createDataFrame([("a", 2, 2, 1), ("a", 3, 3, 2), ("b", 4, 4, 3)], "k string, v int, w int, pos int")
    once = writes.upsert(t, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [("a", 3, 1), ("b", 4, 4)]
    assert sorted(map(tuple, writes.upsert(once, new, ["k"], ["v"]).collect())) == [("a", 3, 1), ("b", 4, 4)]


def test_match_audit_names(spark):
    orgs = spark.createDataFrame([(1, "Alpha Lab", None), (2, "BETA  lab", None), (3, "Gam-ma", "Old"), (4, "x.y", None), (5, "xy", None)], "entity_id int, name string, original_name string")
    names = spark.createDataFrame([("Alpha Lab",), ("beta lab",), ("gamma",), ("Old",), ("x-y",)], "name string")
    got = {r.name: (r.entity_id, r.tier) for r in joins.match_audit_names(orgs, names).collect()}
    assert got == {"Alpha Lab": (1, "exact"), "beta lab": (2, "normalized"), "gamma": (3, "loose"), "Old": (3, "exact")}


def test_chunk_lines(spark):
    df = spark.createDataFrame([("ää\nb\n" + "c" * 12 + "\nd",)], "t string")
    got = writes.chunk_lines(df, F.col("t"), 7).orderBy("piece_no").collect()
    assert [(r.piece, r.oversize) for r in got] == [("ää\nb", False), ("c" * 12, True), ("d", False)]


def test_website_and_summary_rules(spark):
    assert value(spark, P.website_rules, "https://a.org/news") == []
    assert value(spark, P.website_rules, "https://a.org/news/a") == ["news_path"]
    assert value(spark, P.website_rules, "https://x.medium.com/blog/1/2/3/4/5") == ["platform", "path", "deep_path"]
    assert value(spark, P.summary_rules, "y" * 19) == ["short"]
    assert value(spark, P.summary_rules, "y" * 20) == []
    assert value(spark, P.summary_rules, "cookie 登录 " + "y" * 2000) == ["login"]


def test_digest_ledger(spark):
    events = spark.createDataFrame([(1, "o", 7, "2026-01-01 10:00:00"), (2, "o", 9, "2026-01-01 00:00:00"), (3, "o", 9, "2026-01-02 00:00:00"), (4, "o", 5, "2026-01-01 11:00:00")], "id int, organization_id string, relevance_score int, created_at string")
    orgs = spark.createDataFrame([("o",)], "entity_id string")
    none = spark.createDataFrame([], "window_start string, window_end string, content_hash string, status string")
    window = ("2026-01-01 00:00:00", "2026-01-02 00:00:00")
    run = cleaning.digest_run(events, orgs, none, *window).first()
    assert (run.event_count, run.action) == (2, "create")
    for status, action in (("pushed", "skip"), ("failed", "reopen")):
        known = spark.createDataFrame([(*window, run.content_hash, status)], none.schema)
        assert cleaning.digest_run(events, orgs, known, *window).first().action == action


def test_text_functions(spark):
    assert value(spark, T.title_key, "Ab-c, D_e! 新闻。") == "abcde新闻"
    assert value(spark, lambda c: T.note_field(c, "suggested_name"), "suggested_name=New Name; other=1") == "New Name"
    assert value(spark, T.canonical_name, "Some Lab (SL), 2024") == "Some Lab"
    assert value(spark, cleaning.parse_score, 'the score is: 7.5') == 7.5
    assert value(spark, lambda c: cleaning.context_body(c, 10), "abc\n\ndefg\nhijklmn") == "abc\ndefg"
