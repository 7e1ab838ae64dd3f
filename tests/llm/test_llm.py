"""The training-data operators against brute force, on fixtures with nulls, empties, ties, repeats and odd columns."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from orgwatch.llm import ann, blocks, chat, components, extraction, langid, mixing, neardup, packing, pii, quality, queries, secrets, template, tokens

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of every awkward kind: null and empty texts, a repeated row, a very long text, a null id and source, extra columns.
ODD = [
    (1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (3, " \n ", None, None, "x"), (4, "one two three", "en", "b", None), (4, "one two three", "en", "b", None),
    (5, "long word " * 30_000, "de", "a", "x"), (None, "no id here at all, it is gone", "en", "b", "x"), (7, "ÄÖ ß 漢字 😀 <|endoftext|>", "de", None, "x"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, _n string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


# 1 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, docs):
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95


def test_language_odd(spark, odd):
    model = langid.fit(odd)
    got = langid.predict(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in got][:3] == [("und", 0.0)] * 3
    assert all(r.lang_pred in ("en", "de") for r in got[3:]) and got[0]._n == "x"
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def brute_languages(train, asked, clusters, quantile, scale):
    """(language, score, rejected) of each text by plain dictionaries: TF-IDF of hashed n-grams, spherical k-means, cosine."""
    mask = 0xFFFFFFFF

    def grams(text):
        x = [32, *((ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32 for c in text or ""), 32]
        x = [c for i, c in enumerate(x) if not (c == 32 and i and x[i - 1] == 32)]
        if len(x) < 3:
            return {}
        a = [c * 0x9E3779B1 & mask for c in x]
        b = [((u ^ u >> 15) * 0x85EBCA6B + c * 0xC2B2AE35) & mask for u, c in zip(a, x[1:])]
        d = [((u ^ u >> 13) * 0x27D4EB2F + c * 0x165667B1) & mask for u, c in zip(b, x[2:])]
        return collections.Counter(h >> 32 - langid.BITS for h in [u for u, c in zip(a, x) if c != 32] + b + d)

    df = collections.Counter(g for t, _ in train for g in grams(t))
    idf = lambda g: math.log((1 + len(train)) / (1 + df[g])) + 0.1

    def vector(text):
        return unit({g: math.log1p(n) * idf(g) for g, n in grams(text).items()})

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    dot = lambda u, v: sum(x * v.get(g, 0) for g, x in u.items())
    first = lambda values, best: next(i for i, v in enumerate(values) if v == best(values))
    model = []
    for lang in sorted({x for _, x in train}):
        x = [v for v in map(vector, sorted({t for t, k in train if k == lang and t})) if v]
        if not x:
            continue
        mean = collections.Counter()
        for v in x:
            mean.update(v)
        c = [x[first([dot(v, mean) for v in x], max)]]
        while len(c) < min(clusters, len(x)):
            c.append(x[first([max(dot(v, u) for u in c) for v in x], min)])
        for _ in range(12):
            own = [first([dot(v, u) for u in c], max) for v in x]
            for j in range(len(c)):
                total = collections.Counter()
                for v, o in zip(x, own):
                    if o == j:
                        total.update(v)
                c[j] = unit(total) or c[j]
        near = [(first([dot(v, u) for u in c], max), max(dot(v, u) for u in c)) for v in x]
        for j, u in enumerate(c):
            mine = [s for o, s in near if o == j]
            model.append((lang, u, float(np.quantile(mine, quantile)) * scale if mine else 0.0))
    out = []
    for t in asked:
        v = vector(t)
        s = [dot(v, u) for _, u, _ in model]
        best = first(s, max) if v else 0
        out.append((model[best][0], s[best], s[best] < model[best][2]) if v else ("und", 0.0, True))
    return out


def test_language_against_brute_force(spark, docs):
    some = [r for i, r in sorted(docs.items()) if r.text and len(r.text) < 1500][:120]
    train = [(r.text, r.lang) for r in some[:80] if r.lang]
    asked = [r.text for r in some[80:]] + ["Ωμέγα ψυχή λόγος κόσμος", "zqx xqz qqzx zzxq", "12 34", "", None, "a", "Ünïcödé ßtraße ŁÓDŹ"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"), clusters=2, reject_quantile=0.1, reject_scale=0.9)
    got = langid.predict(spark.createDataFrame(list(enumerate(asked)), "i long, text string"), model).orderBy("i").collect()
    want = brute_languages(train, asked, 2, 0.1, 0.9)
    assert [r.lang_pred for r in got] == [w[0] for w in want] and [r.rejected for r in got] == [w[2] for w in want]
    assert all(abs(r.score - w[1]) < 1e-4 for r, w in zip(got, want))
    assert any(r.rejected and r.score > 0 for r in got) and len(set(model.floors)) > len(set(model.languages))


# 2 ---------------------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark, docs):
    pattern = regex.compile(pii.PATTERN)
    for r in queries.op2_pii(spark, SF).collect():
        text, new = docs[r.doc_id].text, r.text
        old, made = pattern.findall(text), pattern.findall(new)
        assert len(old) == len(made) and pattern.split(text) == pattern.split(new)
        assert r.n_pii == sum(a != b for a, b in zip(old, made))
        for a, b in zip(old, made):
            if re.fullmatch(r"\d{13,19}", a):
                assert len(a) == len(b) and luhn(b) == luhn(a) and (a == b) == (not luhn(a))
            else:
                assert a != b


def test_pii_is_a_permutation(spark):
    rows = [(f"{a:03d}-{b:02d}-0001",) for a in (1, 665, 667, 899) for b in range(1, 100)] + [(f"20{y:02d}-{m:02d}-28",) for y in range(50) for m in range(1, 13)]
    rows += [(f"10.{a}.{b}.7",) for a in range(20) for b in range(20)]
    got = pii.pseudonymize(spark.createDataFrame(rows, "text string"), "k")
    assert got.where("n_pii <> 1").count() <= 1 and got.select("text").distinct().count() == len(rows)
    again = pii.pseudonymize(spark.createDataFrame([("x 10.1.1.7, y 10.1.1.7",)], "text string"), "k").first().text
    a, b = re.findall(r"[\d.]+\d", again)
    assert a == b != "10.1.1.7"


def test_pii_odd(spark, odd):
    rows = [("000-11-2222 999.1.1.1 2023-02-29 4785380592391130",), (None,), ("",)]
    got = [tuple(r) for r in pii.pseudonymize(spark.createDataFrame(rows, "text string"), "k").collect()]
    assert got == [(rows[0][0], 0), (None, 0), ("", 0)]
    same = pii.pseudonymize(odd, "k")
    assert same.columns == [*odd.columns, "n_pii"] and [r.text for r in same.collect()] == [r[1] for r in ODD]
    assert pii.pseudonymize(empty(spark), "k").count() == 0


def test_pii_long_texts(spark):
    """200,000 characters of what each pattern loops over; nothing may recurse."""
    long = ["x@" + "a." * 100_000 + "ab", "a" * 200_000 + "@b.cd", "x@" + "a" * 200_000, "1" * 200_000, "1." * 100_000, "12-" * 66_000, "+1 " * 66_000, "+12 34" * 33_000, "(555) " * 33_000, "2024-01-" * 25_000]
    got = [r.n_pii for r in pii.pseudonymize(spark.createDataFrame([(t,) for t in long], "text string"), "k").collect()]
    assert got[:4] == [1, 1, 0, 0]


def test_pii_validates(spark):
    stay = "000-000-0000 011-555-0000 212-055-0000 01.2.3.4 256.1.1.1 32/12/2024 30/02/2024 29/02/2023 13/13/2024 +123 45 6 x@y +1 123456"
    rows = [stay, "+14155550123", "+44 20 7946 0958", "+49 30 1234567", "(212) 555-0187", "25/12/2024", "31/12/2024", "04/05/2024", "a@b.com.", "+4915112345678"]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame([(t,) for t in rows], "text string"), "k").collect()]
    assert got[0] == stay
    for old, new in zip(rows[1:], got[1:]):
        assert old != new
        if "@" not in old:
            assert re.sub("[0-9]", "0", old) == re.sub("[0-9]", "0", new)
    assert got[1][:2] == "+1" and re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", got[4]) and got[5][:2] > "12" and got[6][:2] > "12" and got[8].endswith(".invalid.")
    days = [(f"{d}/{m:02d}/20{y:02d}",) for d in range(13, 32) for m in range(1, 13) for y in range(0, 20, 7) if d < 29]
    moved = pii.pseudonymize(spark.createDataFrame(days, "text string"), "k")
    assert moved.select("text").distinct().count() == len(days) and moved.where("n_pii = 1").count() >= len(days) - 1
    other = pii.pseudonymize(spark.createDataFrame([("(212) 555-0187",)], "text string"), "another key").first().text
    assert other != got[4]


def masked(spark, rows):
    return [r.text for r in pii.pseudonymize(spark.createDataFrame([(t,) for t in rows], "text string"), "k").collect()]


def test_pii_short_groups_and_dates(spark):
    """Groups of one digit, a trunk 0, dates without leading zeros, the last days of a month, 29 February."""
    rows = ["+33 1 23 45 67 89", "+45 12 34 56 78", "0415 555 1234", "01632 960123", "5/3/2021", "25/3/2021", "5.3.2021", "29/02/2024", "30/04/1984", "31/12/1999", "05/03/2021"]
    got = masked(spark, rows)
    for old, new in zip(rows, got):
        assert old != new, old
        if "/" not in old and old.count(".") != 2:
            assert re.sub("[0-9]", "0", old) == re.sub("[0-9]", "0", new)
    parts = lambda t: [int(x) for x in re.split("[/.]", t)]
    assert got[0][:4] == "+33 " and got[2][0] == got[3][0] == "0"
    assert parts(got[4]) == parts(got[10]) and "0" not in (got[4][0], got[5].split("/")[1][0], got[6][0])
    import datetime

    for old, new in zip(rows[4:], got[4:]):
        d, m, y = parts(new)
        d, m = (m, d) if "/" in old and parts(old)[0] <= 12 else (d, m)
        datetime.date(y, m, d)
        assert ("/" not in old or parts(old)[0] <= 12 or d > 12) and 1800 <= y < 2200


def test_pii_day_first_is_a_permutation(spark):
    """All dates of 400 years whose day can be no month: each becomes another one, none twice."""
    days = spark.sql("select date_format(d, 'dd/MM/yyyy') as text from (select explode(sequence(date'1800-01-01', date'2199-12-31')) as d) where day(d) > 12")
    got = pii.pseudonymize(days, "k")
    assert days.count() == 9 * 9833 == got.select("text").distinct().count() == got.join(days, "text", "left_semi").count()
    assert got.where("n_pii = 1").count() >= 9 * 9833 - 20


def test_pii_findings_do_not_depend_on_neighbours(spark):
    """Whatever PATTERN finds has the hint that lets it be looked for; a text and the same text with an address behind it
    lose the same values."""
    import random

    pattern, hint, draw = regex.compile(pii.PATTERN), re.compile(pii.HINT), random.Random(2)
    seeds = ["+45 12 34 56 78", "+33 1 23 45 67 89", "(212) 555-0187", "+1 212-555-0187", "4111 1111 1111 1111", "078-05-1120", "10.0.0.1", "5/3/2021", "2021-03-05", "0415 555 1234", "+4915112345678", "x"]
    rows = []
    for _ in range(1500):
        t = list(" ".join(draw.choice(seeds) for _ in range(draw.randint(1, 2))))
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(len(t))] = draw.choice("0123456789 .-/()+@a")
        rows.append("".join(t))
    for t in rows:
        assert all(hint.search(m[0]) for m in pattern.finditer(t)), t
    assert [t + " , mail " for t in masked(spark, rows)] == [t[: t.rindex("u")] for t in masked(spark, [t + " , mail a@b.org" for t in rows])]


# 3 ---------------------------------------------------------------------------------------------------------------


def targets(sizes, share=1.5):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    out, left, rest = {}, share * sum(sizes.values()), dict(weights)
    while rest:
        level = left / sum(rest.values())
        full = [s for s in rest if rest[s] * level >= 2 * sizes[s]]
        if not full:
            return out | {s: w * level for s, w in rest.items()}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del rest[s]
    return out


def test_mixing(spark, docs):
    got = queries.op3_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == len(W.findall(docs[r.doc_id].text or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[s] += r.size
        taken[s] += r.taken
    want = targets(sizes)
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
    assert all(abs(taken[s] - want[s]) <= max(0.05 * want[s], 3 * 64) for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op3_mixing(spark, SF).collect()))


def test_mixing_odd(spark, odd):
    got = mixing.mix_totals(mixing.mix_plan(odd)).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert sorted(r.size for r in got) == sorted(len(W.findall(r[1] or "")) for r in ODD)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    words = sum(len(W.findall(r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mix_totals(mixing.mix_plan(empty(spark))).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_shards_draw_multinomials(spark):
    """Counts of a source over shards have a multinomial's mean and variance, and the totals are the targets."""
    rows = [(None, 1, 640_000, 300_000.0), ("b", 2, 640_000, 900_000.0), ("c", 3, 64_000, 120_000.0), ("d", 4, 0, 0.0)]
    sources = spark.createDataFrame(rows, "source string, _sid long, source_size long, target double")
    slots = mixing.mix_slots(sources, seed=1, block_words=64, shard_slots=100, cap=2.0)
    got = collections.defaultdict(collections.Counter)
    seen = collections.defaultdict(collections.Counter)
    for r in slots.collect():
        got[r._sid][r._shard] += 1
        seen[r._sid][r._block] += 1
    want = {s: int(t / 64 + 0.5) for _, s, _, t in rows[:3]}
    assert {s: sum(c.values()) for s, c in got.items()} == want
    for _, s, size, _ in rows[:3]:
        assert max(seen[s]) < size // 64 and max(seen[s].values()) <= 2
        p, counts = want[s] / sum(want.values()), np.array([got[s][k] for k in range(150)])
        assert abs(counts.mean() - 100 * p) < 3 and 0.6 < counts.var() / (100 * p * (1 - p)) < 1.6


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(1)])).collect()
    assert sorted(r[0] for r in got) == list(range(n))


@pytest.mark.parametrize("turned", [False, True])
def test_mixing_tells_rows_apart(spark, turned):
    """Two rows under one id whose other columns hash alike, in both orders, and repeated rows: no text is lost."""
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(5, words, None), (5, None, words), (6, "a b c", "s"), (6, "a b c", "s")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, source string, text string")
    got = collections.Counter((r.source, r.text) for r in mixing.mix_documents(docs).collect())
    assert got[None, words] == 1 and got["a b c", "s"] == 4 and all(t is not None and s != words for s, t in got)
    assert 400 < sum(len(W.findall(t)) * n for (s, t), n in got.items() if s is None) < 500


# 4 ---------------------------------------------------------------------------------------------------------------


def check_packing(got, texts):
    """Every id in one piece, sequences gapless and without padding; returns the cuts beyond those that 4096 forces."""
    whole = tokens.tokenizer(tokens.default_path()).whole
    pieces, sequences, cuts = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all
    for doc_id, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        cuts += len(pieces[doc_id]) - -(-len(ids) // 4096)
    return cuts


def test_packing(spark, docs):
    check_packing(queries.op4_packing(spark, SF).collect(), {k: r.text for k, r in docs.items()})


def test_packing_classes(spark):
    """Bins of a class hold its fixed number of whole pieces, and few documents are cut."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op4_packing(spark, "/root/testdata/sf0.01").collect()
    assert check_packing(got, docs) <= 0.8 * len(docs)
    uncut = collections.Counter(r.sequence_id for r in got if r.length == min(r.doc_tokens, 4096))
    assert sum(n == 4096 // r.length for r in got if (n := uncut[r.sequence_id]) and r.length == r.doc_tokens) > 0.3 * len(docs)


def test_packing_with_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, rng.integers(0, 99, int(rng.integers(0, 60)))))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, capacity=64, with_ids=True, rows_a_task=20).collect()
    encode, back, full = tokens.tokenizer(tokens.default_path()).encode, collections.defaultdict(dict), collections.Counter()
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        back[r.doc_id][r.start] = bytes(r.ids)
        full[r.sequence_id] += r.length
    assert all(b"".join(back[i][k] for k in sorted(back[i])) == encode(t) + b"\x02\0\0\0" for i, t in rows)
    assert sorted(full) == list(range(len(full))) and all(n == 64 or n & (n - 1) == 0 for n in full.values())


def test_packing_odd(spark, odd):
    got = packing.pack(odd).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 2 * next(r.doc_tokens for r in got if r.doc_id == 4)
    check_packing([r for r in got], {r[0]: r[1] for r in ODD if r[0] != 4})
    assert packing.pack(empty(spark)).count() == 0


def test_plan_of_bins():
    counts, sizes = np.zeros((5, 10), dtype=np.int64), np.zeros((5, 10), dtype=np.int64)
    counts[1], sizes[1] = 20, 20 * 60  # 200 pieces of 60 in bins of 100: two of five cells' tokens fill the gaps
    assert packing.plan_bins(counts, sizes, 100) == 5
    assert packing.plan_bins(counts * 0, sizes * 0, 100) == 10


def test_tokenizer_is_the_library():
    t = tokens.WordTokenizer(tokens.default_path(), remembered=50)
    for text in ["it's <|endoftext|> x", "Ünïcode x\tİstanbul ΣΑΣ é ½ ² ４２ can't!! we'll", "", "  a  \n\n b ", "ﬁ 漢字 テスト 😀", "a.b,c .,. 12 don't", "é x́"]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_tokenizer_on_every_code_point():
    t = tokens.WordTokenizer(tokens.default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 23 == 0)]
    texts = [f"a{c}b? {c} x{c}" for c in points]
    for text, want in zip(texts, t.whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(t.encode(text), "<u4").tolist() == want.ids, text


# 5 ---------------------------------------------------------------------------------------------------------------


def grams(text):
    w = W.findall(text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_links(texts):
    """(links of each row, least row of its class) by comparing all rows that share a 5-gram."""
    sets, inv = [grams(t) for t in texts], collections.defaultdict(list)
    links, parent = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in inv[g])
        for j, k in common.items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            inv[g].append(i)
    return links, [find(i) for i in range(len(texts))]


def near_copies():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    out = []
    for i in range(90):
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            copy[at] = f"x{rng.integers(0, 99)}"
        out.append(" ".join(copy))
    return out + [" ".join(f"y{j}" for j in rng.integers(0, 999, 60)) for _ in range(20)] + ["a b c", "a b c", "a b", "", "same same same same same same", None]


@pytest.mark.parametrize("block, grams", [(4, 300_000), (16, 300_000), (256, 300_000), (256, 900)])
def test_similar_documents(spark, block, grams):
    texts = near_copies()
    links, least = brute_links(texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_links int")
    got = {r.doc_id: r for r in neardup.similar_documents(df, block=block, block_grams=grams).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == least
    kept = neardup.drop_similar(df, block=block, block_grams=grams)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


def test_similar_on_documents(spark, docs):
    ids = sorted(docs)
    links, least = brute_links([docs[i].text for i in ids])
    got = {r.doc_id: r for r in queries.op5_jaccard_join(spark, SF).collect()}
    assert [(got[i].n_links, got[i].class_id) for i in ids] == [(n, ids[c]) for n, c in zip(links, least)]


def test_similar_odd(spark, odd):
    got = neardup.similar_documents(odd).collect()
    assert collections.Counter(r.n_links for r in got) == {0: 6, 1: 2}
    assert sorted((r.doc_id is None, r.doc_id) for r in neardup.drop_similar(odd).collect() if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 4, 5, 7)]
    assert neardup.drop_similar(odd).where("doc_id is null").count() == 1
    assert neardup.similar_documents(empty(spark)).count() == 0 and neardup.drop_similar(empty(spark)).count() == 0


def test_similar_with_one_id_for_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (1, "c d e f g h"), (2, a + " tail"), (3, b + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.similar_documents(df).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    # Unrelated texts under one id all stay, and so does the only copy of a text whose id another text has.
    assert sorted(map(tuple, neardup.drop_similar(df).collect())) == sorted(rows[:3])
    more = [(None, a), (None, a), (None, b), (7, b), (7, b), (None, None), (None, None), (8, " "), (8, " ")]
    kept = neardup.drop_similar(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, a), (7, b), (None, None), (None, None), (8, " "), (8, " ")]))


def test_large_component_is_exact(spark):
    """A component of several blocks, with tight and loose nodes: the links are those of brute force."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(240):
        copy = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 3 if i % 4 else 9))):
            copy[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(copy[: 150 - int(rng.integers(0, 12)) * (i % 5 == 0)]))
    links, least = brute_links(texts)
    assert min(links) < max(links) - 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in neardup.similar_documents(df, block=12).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(links, least))


def template_rows(n, seed):
    """Texts that share a third of their 5-grams: one page's frame around words of their own."""
    draw = np.random.default_rng(seed)
    frame = " ".join(f"frame{i}" for i in range(64))
    return [(i, frame + " " + " ".join(f"w{x}" for x in draw.integers(0, 10**9, 120))) for i in range(n)]


def test_templates_do_not_grow_into_one_component(spark, monkeypatch):
    """2,000 loose documents meet in many buckets by chance, but few come to be compared; near copies among them are found."""
    rows = template_rows(2000, 4)
    rows += [(3000 + i, rows[i][1] + " one more word") for i in range(0, 2000, 50)]
    seen = []
    whole = neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    got = {r.doc_id: r for r in neardup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, least = brute_links([t for _, t in rows[:2000:50] + rows[2000:]])
    assert all(got[3000 + i].class_id == i and got[3000 + i].n_links == got[i].n_links == 1 for i in range(0, 2000, 50))
    assert sum(r.n_links for r in got.values()) == 80 and len(least) == 80
    assert seen[0] < 40 * 60  # edges: those of the near copies, a bucket each


def test_components(spark):
    """Chains, stars and trees against union-find."""
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(int(a), int(b)) for a, b in rng.integers(400, 520, (90, 2))] + [(1, 1)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components.components(spark.createDataFrame(edges + edges[:5], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in parent)


def test_pruning_keeps_what_may_reach():
    assert [neardup.least_matches(n, 0.8, 1e-6) for n in neardup.STAGES] == sorted(neardup.least_matches(n, 0.8, 1e-6) for n in neardup.STAGES)
    assert 0 < neardup.least_matches(64, 0.8, 1e-6) < 0.8 * 64


# 6 ---------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q, v in asked:
        s = ann.cosines(np.broadcast_to(np.array(v, float), x.shape), x)
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0])
    got = collections.defaultdict(dict)
    for r in queries.op6_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(got) == sorted(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_nearest_odd(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(20)] + [(20 + i, list(map(float, rng.normal(size=3)))) for i in range(8)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [1.0, float("inf"), 1.0]), (104, [1.0, None, 1.0]), (105, []), (106, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame([*rows, *bad, rows[3]], "vec_id long, embedding array<double>")
    want = brute_nearest(rows, rows)
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, df, block=4).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = spark.createDataFrame(rows[18:22], "vec_id long, embedding array<double>")
    assert ann.nearest(few, few).groupBy("query_id").count().where("count <> 3").count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(none, none).count() == 0 and ann.nearest(few, none).count() == 0


@pytest.mark.parametrize("size, expected", [(4, 0.35), (8, 0.35), (8, 0.6), (11, 0.35), (11, 0.6)])
def test_probes_reach_the_mass(size, expected):
    index = ann.Index(64, round(1024 * 2 ** (1.6 * size)), expected)
    assert index.size == size
    rng = np.random.default_rng(5)
    q = ann._unit(rng.normal(size=(6, 64)))
    spread, phi = (1 - index.expected**2) ** 0.5, lambda z: ann._PHI(z).astype(float)
    found = []
    for t in range(index.tables):
        f, own = index.place(q, t)
        for i in range(len(q)):
            cells = index.probes(f[i], own[i], t)
            assert (cells[0] == own[i]).all() and len(np.unique(cells, axis=0)) == len(cells)
            low = cells * index.width - index.shift[t] - index.expected * f[i]
            assert (phi((low + index.width) / spread) - phi(low / spread)).prod(axis=1).sum() >= index.mass - 1e-9
            found.append(set(index.name(cells)))
    # Neighbours drawn at the expected cosine: nine of ten lie in a visited bucket of some table.
    hits = total = 0
    for i in range(len(q)):
        z = rng.normal(size=(300, 64))
        z = ann._unit(z - (z @ q[i])[:, None] * q[i])
        near = index.expected * q[i] + (1 - index.expected**2) ** 0.5 * z
        hit = np.zeros(len(near), dtype=bool)
        for t in range(index.tables):
            hit |= np.array([x in found[t * len(q) + i] for x in index.name(index.place(near, t)[1])])
        hits, total = hits + hit.sum(), total + len(near)
    assert hits >= 0.9 * total


def test_nearest_at_more_rows(spark):
    """The hash functions of a table of some 7 million rows, and visits handed on in pieces smaller than a query's."""
    rng = np.random.default_rng(6)
    rows = [(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(1500, 32)))]
    asked = rows[::100]
    want = brute_nearest(rows, asked)
    schema = "vec_id long, embedding array<double>"
    got = collections.defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), bucket_rows=len(rows) / 2**12.8).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) >= 0.9 * 5 * len(want)


def test_nearest_widens(spark):
    """Queries far from all rows find their neighbours too, and a query's own bucket may be empty."""
    rng = np.random.default_rng(8)
    near = rng.normal(size=(600, 16)) * 0.05 + np.eye(16)[rng.integers(0, 3, 600)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(near)]
    asked = [(1000 + i, list(map(float, v))) for i, v in enumerate(np.concatenate((-np.eye(16)[:4], rng.normal(size=(6, 16)))))]
    want = brute_nearest(rows, asked)
    schema = "vec_id long, embedding array<double>"
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), bucket_rows=4).collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == sorted(want) and all(len(v) == 5 for v in got.values())


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = W.findall(text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = 0
    for r in queries.op7_quality_rules(spark, SF).collect():
        want = brute_quality(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            wrong += r.kept != bool(labels[r.doc_id])
    assert wrong <= 0.02 * len(labels)


def test_quality_odd(spark, odd):
    got = quality.score_quality(odd)
    assert {"doc_id", "text", "lang", "source", "_n"} <= set(got.columns)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
    assert quality.score_quality(empty(spark)).count() == 0


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.7, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and np.abs(table[1][:, 2] - (0.95, 0.9, 0.7, 0.85)).max() < 0.05


# 8 ---------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets(spark, docs):
    for r in queries.op8_secret_scans(spark, SF).collect():
        want = brute_secrets(docs[r.doc_id].text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_ledger_is_incremental(spark):
    schema = "path string, text string, blob int, spans int"
    key = "TOKEN = 'abcdef0123456789abcdef01'"
    one = spark.createDataFrame([("a", key, 1, 1), ("b", key, 1, 1), ("c", None, 1, 1), ("d", "AKIA" + "B" * 16, 1, 1)], schema)
    ledger = secrets.scan_versions(one)
    assert ledger.count() == 3
    marked = ledger.withColumn("spans", F.array(F.struct(F.lit("old").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))))
    two = spark.createDataFrame([("a", key, 1, 1), ("e", "new secret: 'hunter22'", 1, 1)], schema)
    again = {r.blob: [s.kind for s in r.spans] for r in secrets.scan_versions(two, marked).collect()}
    assert sorted(again.values()) == [["assign"], ["old"]]  # the known blob was not scanned again
    stale = marked.withColumn("rule_version", F.lit("other"))
    assert ["old"] not in [[s.kind for s in r.spans] for r in secrets.scan_versions(two, stale).collect()]
    got = {r.path: r for r in secrets.findings_by_version(one, ledger).collect()}
    assert got["a"].summary.spans == got["b"].summary.spans == "assign:0:32,hex:9:33".replace("32", "33") and got["c"].summary.spans == ""
    assert got["d"].summary.n_access == 1 and got["a"].blob == 1
    none = spark.createDataFrame([], schema)
    assert secrets.findings_by_version(none, secrets.scan_versions(none)).count() == 0


def test_secret_scan_is_linear():
    """A megabyte of what each rule loops over."""
    for text in ("eyJ-" * 250_000, "eyJ-." * 200_000, "AKIA" * 250_000, "password" * 125_000, "token " * 160_000, "secret=" * 140_000, "ghp_" * 250_000, "xoxb-" * 200_000, "-----BEGIN " * 90_000, "0f" * 500_000, "api_key" + " " * 1_000_000):
        began = time.process_time()
        secrets.scan_text(text)
        assert time.process_time() - began < 2, text[:12]
    token = "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl-x_y"
    assert secrets.scan_text(f"x {token}, y") == [("jwt", 2, 2 + len(token))] and secrets.scan_text(f"-{token}") == []


def test_findings_of_a_hot_blob(spark):
    rows = spark.range(3000).selectExpr("id as path", "case when id % 3 = 0 then 'password: hunter22' else concat('text ', id) end as text", "id as _salt")
    got = secrets.findings_by_version(rows, secrets.scan_versions(rows)).collect()
    assert len(got) == 3000 and all((r.summary.n_assign == 1) == (r.path % 3 == 0) and r._salt == r.path for r in got)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_extraction(spark):
    import html

    got = {r.page_id: r for r in queries.op9_html_extraction(spark, SF).collect()}
    wrong = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in parts if x)
        wrong += got[r.page_id].text != want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert wrong <= 0.02 * len(got)


def test_blocks():
    page = "<head><title>T</title></head><body><nav><a href='x>y'>Home &amp; more</a></nav><p>One <b>two<br>three<p>four</p><script>var a='<p>no</p>'</script><ul><li>x<li>y</ul><!-- <p>no</p> --><img src=x>z<"
    got = [(b.text, b.path, round(b.linked, 1)) for b in blocks.leaf_blocks(page)]
    assert got == [("Home & more", ("body", "nav"), 1.0), ("One two three", ("body", "p"), 0.0), ("four", ("body", "p"), 0.0), ("x", ("body", "ul", "li"), 0.0), ("y", ("body", "ul", "li"), 0.0), ("z<", ("body",), 0.0)]
    assert [b.text for b in blocks.leaf_blocks("a<p>b<!-- c <p>d</p> e")] == ["a", "b"] and [b.text for b in blocks.leaf_blocks("x > y <b")] == ["x > y <b"]
    assert blocks.leaf_blocks("") == [] and len(blocks.leaf_blocks("<div>" * 5000 + "x")) == 1


@pytest.mark.parametrize(
    "page", ["<a " * 60_000, '<a "' * 60_000, "<x>y" * 30_000, "<div>x" * 30_000, "<p><div>" + "<x>" * 30_000, "<div>" * 30_000 + "</b2>" * 30_000, "<!-" * 60_000, "<a '\">" * 30_000, "<![" * 60_000 + ">"]
)
def test_blocks_are_linear(page):
    began = time.process_time()
    found = blocks.leaf_blocks(page)
    extraction.vectors(found[-50:]), [extraction.markup_label(b) for b in found]
    assert time.process_time() - began < 3


def test_group_of_pages_is_bounded():
    """One long page does not make a group of short ones long."""
    sizes = []

    class Spy(extraction.Labeller):
        def probabilities(self, x, mask):
            sizes.append(x.shape[:2])
            return np.ones(mask.shape, np.float32)

    short, long = "<p>a</p>" * 10, "<p>b</p>" * 3000
    assert extraction.main_texts([short] * 127 + [long, None], Spy(), steps=4000) == ["\n".join("a" * 10)] * 127 + ["\n".join("b" * 3000), ""]
    assert sum(n for n, _ in sizes) == 128 and max(n * steps for n, steps in sizes) <= 4000


def test_labeller_gradient():
    """Back-propagation against differences."""
    rng = np.random.default_rng(0)
    m = extraction.Labeller(1)
    rows = [rng.normal(size=(n, extraction.WIDTH)).astype(np.float32) for n in (3, 5)]
    x, mask = extraction.padded(rows)
    d = rng.normal(size=(2, 5, extraction.HIDDEN)).astype(np.float32) * mask[:, :, None]
    kept = []
    m._run(x, mask, m.p["fw"], m.p["fb"], kept)
    dw, _ = m._back(x, d, m.p["fw"], kept)
    for i, j in [(0, 0), (extraction.WIDTH + 3, 5), (10, 70), (extraction.WIDTH + 1, 30)]:
        w = m.p["fw"].astype(np.float64)
        both = []
        for e in (1e-3, -1e-3):
            v = w.copy()
            v[i, j] += e
            both.append(float((m._run(x.astype(np.float64), mask, v, m.p["fb"], None) * d).sum()))
        assert abs((both[0] - both[1]) / 2e-3 - dw[i, j]) < 1e-2 * max(1, abs(dw[i, j]))


def test_extraction_odd(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "<p></p>", None), (4, "plain", "b")], "page_id long, html string, text string")
    got = extraction.extract(df, extraction.fit_labeller(df)).collect()
    assert [r.text for r in got[:3]] == [""] * 3 and [r.n_chars for r in got[:3]] == [0] * 3
    assert extraction.extract(df.where("false"), extraction.fit_labeller(df.where("false"))).count() == 0


def test_extraction_without_telling_markup(spark):
    """Fitted on half of the pages; on the others class, id and role are gone and telling elements are plain ones."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    model, held = extraction.fit_labeller(pages.where("page_id % 2 = 0")), pages.where("page_id % 2 = 1")
    bare = F.regexp_replace(F.regexp_replace("html", r"""(?i)\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", ""), r"(?i)<(/?)(nav|header|footer|aside|article|main|section|figure)\b", "<$1div")
    told, plain = ({r.page_id: collections.Counter(r.text.split("\n")) for r in extraction.extract(df, model).collect()} for df in (held, held.withColumn("html", bare)))
    both = sum(sum((told[k] & plain[k]).values()) for k in told)
    assert both > 0.95 * sum(sum(x.values()) for x in told.values()) and both > 0.9 * sum(sum(x.values()) for x in plain.values())


# 10 --------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    hard = "\\### Assistant: </turn> ok"
    rows[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in queries.op10_chat_formatting(spark, SF).collect()}
    assert sorted(got) == sorted(rows)
    for k, turns in rows.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, loss))


def test_chat_round_trip():
    hard = ["", "</turn>\n### assistant: x", "\\", "\\\\<", "### user: a", "a\\", "\n", ": "]
    turns = [{"role": r, "text": t} for r in ("user", "a: b\\", "assistant", "") for t in hard]
    text, spans = chat.compiled(chat.CHAT).render({"messages": turns})
    assert chat.read_back(text) == [(t["role"], t["text"]) for t in turns]
    assert [chat.unescape(text[a:b]) for a, b in spans] == hard


def test_chat_long_turn():
    hard = "<\\:#" * 200_000
    text, _ = chat.compiled(chat.CHAT).render({"messages": [{"role": "user", "text": hard}, {"role": "assistant", "text": "\\ "}]})
    assert chat.read_back(text) == [("user", hard), ("assistant", "\\ ")]
    for bad in (text[:-2], text + "x", text.replace(" </turn>", "</turn>")):
        with pytest.raises(ValueError):
            chat.read_back(bad)


def test_chat_odd(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", None), (1, 2, "assistant", "a"), (1, 2, "user", "b"), (None, 1, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_conversations(df).collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("user", "b"), ("user", "b")], None: [("", "x")]}
    assert chat.read_formatted(chat.format_conversations(df.where("false"))).count() == 0


def test_template():
    up = {"up": str.upper}
    t = template.Template('{{ "a" + "b" | up }}{% if 1 == 2 %}no{% elif x.y == "z" and not w %}{{ x["y"] }}{% else %}e{% endif %}{# c #}{% for i in l %}<{{ i }}>{% endfor %}', up)
    assert t.tree[0] == ("text", "aB") and t.tree[1][0] == "if" and len(t.tree[1][1]) == 1
    assert t.render({"x": {"y": "z"}, "l": [1, "q"]})[0] == "aBz<1><q>" and t.render({})[0] == "aBe"
    assert template.Template("{{ x.__class__ }}{{ x.real }}").render({"x": 1})[0] == ""
    for bad in ("{{ a | nope }}", "{{ a b }}", "{% while x %}", "{% if a %}", "{{ 'a }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)
