"""Shards, filter interactions and spelling variants against brute force."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from orgwatch.llm import audit, queries, sharding, spelling

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (3, " \n ", None, None, "x"), (4, "one two three", "en", "b", None), (4, "one two three", "en", "b", None),
    (5, "long word " * 30_000, "de", "a", "x"), (None, "no id here at all, it is gone", "en", "b", "x"), (7, "ÄÖ ß 漢字 😀 <|endoftext|>", "de", None, "x"),
    (9, "one two three", "en", "", "x"), (None, "one two three", "en", "a", "x"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, _h string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


# 11 --------------------------------------------------------------------------------------------------------------


def greedy(sizes, capacity, shards):
    used, room = 0, 0
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


def minimax(sizes, shards):
    """The smallest capacity, by trying all sums of neighbours."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in sums if greedy(sizes, c, shards))


def line_of(sizes, known):
    end = np.concatenate([[0], np.cumsum(sizes)])
    at = sorted({0, len(sizes), *known})
    return sharding.Line(np.array(at) - 1, end[at])


@pytest.mark.parametrize("seed", range(30))
def test_line_bounds_hold(seed):
    """With few known ends the bounds enclose the true answer, and subdividing what was asked for closes them."""
    draw = random.Random(seed)
    sizes = [draw.choice((1, 3, 10, 40)) for _ in range(draw.randint(1, 60))]
    shards, known = draw.randint(1, 12), set()
    best = minimax(sizes, shards)
    total = sum(sizes)
    no, yes = max(-(-total // shards), max(sizes)) - 1, -(-total // shards) + max(sizes)
    for _ in range(100):
        line = line_of(sizes, known)
        no, yes = line.search(shards, no, yes)
        assert no < best <= yes
        if no + 1 == yes:
            break
        asked = line.hidden(no, yes, shards)
        assert asked
        for i in asked:
            known.add(int(line.pos[i] + line.pos[i + 1]) // 2 + 1)
    assert yes == best
    cuts = line.cuts(yes, shards)
    bounds = [-1, *cuts, len(sizes) - 1]
    loads = [sum(sizes[a + 1 : b + 1]) for a, b in itertools.pairwise(bounds)]
    assert sum(loads) == total and max(loads) == best and len(loads) == shards


@pytest.mark.parametrize("cells", [64, 16_384])
def test_minimax_cuts_exact(spark, cells):
    from orgwatch.llm.common import cut_lineage

    draw = random.Random(cells)
    sizes = {draw.getrandbits(60) - (1 << 59): draw.choice((20, 50, 400)) for _ in range(3000)}
    giant = draw.getrandbits(60)
    sizes[giant] = 600_000
    sums = cut_lineage(spark.createDataFrame(list(sizes.items()), "_h long, bytes long"))
    capacity, cuts, giants = sharding.minimax_cuts(sums, 10, cells)
    assert giants == [giant] and capacity == 600_000 and len(cuts) == 8
    rest = [s for h, s in sorted(sizes.items()) if h != giant]
    loads = collections.Counter()
    for h, s in sizes.items():
        if h != giant:
            loads[sum(c is None or h > c for c in cuts)] += s
    low, high = max(rest), sum(rest)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(rest, middle, 9) else (middle + 1, high)
    assert max(loads.values()) == low and len(loads) == 9 and min(loads.values()) > 0.95 * low


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    of_text, slots, loads = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    return loads


def test_sharding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op11_sharding(spark, SF).collect()
    loads = check_shards(rows, docs, 40)
    groups = collections.Counter()
    for _, t in docs:
        groups[t] += len((t or "").encode()) + 16
    assert set(loads) <= set(range(40)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(loads.values()) <= max(max(groups.values()), -(-sum(groups.values()) // 40) + sorted(groups.values())[-1])


def test_sharding_odd(spark, odd, tmp_path):
    rows = sharding.shard_documents(odd, shards=3)
    got = rows.collect()
    check_shards(got, [(r[0], r[1]) for r in ODD], 3)
    assert {r.shard for r in got} == {0, 1, 2} and {r._h for r in got} == {"x", None} and rows.columns[:5] == odd.columns
    sharding.write_shards(rows, str(tmp_path / "out"), rows_a_file=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r.shard, r.slot, r.doc_id, r.text)
    assert collections.Counter(map(key, back.collect())) == collections.Counter(map(key, got))
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert len({r.shard for r in sharding.shard_documents(odd, shards=40).collect()}) == len({r[1] or "" for r in ODD})
    assert {r.shard for r in sharding.shard_documents(odd, shards=1).collect()} == {0}


def test_sharding_hot_group(spark):
    """A third of all rows has one text: it has a shard of its own and the others stay even."""
    docs = spark.range(9000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('copy ', 40) else concat('text number ', id) end as text")
    rows = sharding.shard_documents(docs, shards=40, keep_text=False).collect()
    loads = check_shards(rows, [(i, "copy " * 40 if i % 3 == 0 else f"text number {i}") for i in range(9000)], 40)
    others = sorted(loads.values())[:-1]
    assert max(loads.values()) == 3000 * 216 and others[-1] - others[0] < 0.02 * others[-1]


# 12 --------------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    failing = collections.defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = words.findall(t)
        f = {c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), i is not None and i > least[t])) if bad}
        said = [(q, x) for j, q, x in labels if j == i and i is not None]
        failing[part or ""].append((f, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out = {}
    for part, rows in failing.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                earlier = sum(f in r[0] for r in rows) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), earlier, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def as_audit(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_audit_odd(spark, odd):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, 1), (9, 1, None), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = as_audit(audit.filter_interactions(audit.filter_cells(odd, table)))
    assert got == brute_audit([(r[0], r[1], r[3]) for r in ODD], labels) and len(got) == 600 * 3
    assert audit.filter_interactions(audit.filter_cells(empty(spark), table)).count() == 0
    assert len(as_audit(audit.filter_interactions(audit.filter_cells(odd, table.where("false"))))) == 1800


def test_audit_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op12_filter_interactions"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = queries.op12_filter_interactions(spark, SF)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want


def test_walk_states():
    draw = np.random.default_rng(3)
    masks, counts = np.arange(32), draw.integers(0, 9, (32, 3))
    states = audit.walk(masks, counts)
    for s in range(32):
        assert (states[s] == counts[masks & s == 0].sum(axis=0)).all()


# 13 --------------------------------------------------------------------------------------------------------------


def brute_words(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_groups(n):
    out = {}
    for w in n:
        near = sorted((-n[v], v) for v in n if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n[w] else None
        out[w] = [form, len(near)]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.append(root)
    return {w: (f, r, n[w], k, n[f] if f else None) for w, (f, k, r) in out.items()}


def as_groups(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = brute_words(docs)
    assert as_groups(queries.op13_spelling_variants(spark, SF)) == brute_groups(words)


@pytest.mark.parametrize("pairs", [0, 20, 100_000])
def test_spelling_random(spark, pairs):
    """Words over a few letters: many near ones, hot chunks at every level, repeated letters, chains of forms."""
    draw = random.Random(pairs)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 9))): 5 * 5 ** draw.randint(0, 4) + draw.randint(0, 2) for _ in range(500)}
    for chain in ("abcdefgh", "abcdefg", "abcdeg", "abcdegx"):
        words[chain] = 5 * 7 ** (8 - len(words) % 3)
    words |= {"wörterbuch": 5, "wörterbüch": 25, "wörterbüchs": 125, "wörtterbüchs": 625, "aaaaaa": 5, "aaaaaaa": 26, "aaaaaaaa": 131}
    got = as_groups(spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long"), pairs=pairs))
    assert got == brute_groups(words)
    assert got["wörterbuch"][1] == "wörtterbüchs"


def test_spelling_hot_chunk(spark):
    """Words that share half their letters: no key keeps more than the bound where a rest can still be divided."""
    draw = random.Random(5)
    words = {"internat" + "".join(draw.choice("abcdefgh") for _ in range(8)): draw.randint(5, 500) for _ in range(1500)}
    words |= {w[:-1] + "z": 9000 for w in list(words)[:50]}
    got = as_groups(spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long"), pairs=1000))
    assert got == brute_groups(words)


def test_spelling_odd(spark, odd):
    assert as_groups(spelling.group_spellings(spelling.count_words(odd))) == brute_groups(brute_words([(r[0], r[1]) for r in ODD]))
    assert spelling.group_spellings(spelling.count_words(empty(spark))).count() == 0
    many = spark.createDataFrame([(i, "Straßen ÀÉabcd÷x Letters lETTERS " * 3) for i in (None, 1, 2, 300)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(many).collect()} == brute_words([(i, "Straßen ÀÉabcd÷x Letters lETTERS " * 3) for i in (None, 1, 2, 300)])
    with pytest.raises(ValueError):
        spelling.group_spellings(spelling.count_words(odd), ratio=1)
