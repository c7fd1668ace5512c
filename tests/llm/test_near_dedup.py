"""Near-duplicate classes against all pairs of a small table."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

near_dedup = pytest.importorskip("folioscope.llm.near_dedup")
from folioscope.llm.components import components  # noqa: E402

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows, similarity=0.8):
    """doc row -> smallest id linked, by union-find over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = defaultdict(int)
    for held in at.values():
        for n, i in enumerate(held):
            for j in held[:n]:
                shared[j, i] += 1
    for (i, j), n in shared.items():
        if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted(((r[0], r[1]) for r in near_dedup.near_duplicates(df, **kw).collect()), key=str)


def test_all_pairs_agree(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):  # families at edit rates around the limit
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(8):
            t = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows), " ".join(t)))
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(150):  # one large group, each copy one edit further from the first: links only along a chain
        base = list(base)
        base[rng.randrange(120)] = rng.choice(words)
        rows.append((len(rows), " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "One two."), (1004, "one TWO"), (1003, "One two."), (None, rows[0][1]), (None, "alone and null"), (1005, "x " * 60_000), (1006, "x " * 60_001)]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, node string")
    assert got(df) == classes(rows)
    kept = near_dedup.keep_one(df.filter("doc_id IS NOT NULL"))
    assert kept.columns == df.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(ids) == sorted({c for d, c in classes([r for r in rows if r[0] is not None])})


def test_a_repeated_passage_of_one_copy_hides_no_pair(spark):
    rng = random.Random(21)
    rows = []
    for i in range(12):
        name = lambda n: [f"d{i}w{rng.randrange(10**6)}" for _ in range(n)]  # noqa: B023, E731
        base, passage = name(100), name(15)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + passage * 200))]
    want = classes(rows)
    assert all(c == d - d % 2 for d, c in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(df) == [] and near_dedup.keep_one(df).count() == 0


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**62, 900).astype(np.uint64)
    for share in (0.5, 0.8):
        n = int(900 * 2 * share / (1 + share))
        x, y = np.sort(a[:900]), np.sort(np.concatenate([a[:n], rng.integers(1, 2**62, 900 - n).astype(np.uint64)]))
        agree = []
        for salt in range(12):
            s = near_dedup.signatures([x ^ np.uint64(salt), y ^ np.uint64(salt)], [np.ones(900, int)] * 2)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - share) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    at = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert at == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small,shrink", [(2, 0.95), (1, -1.0)])
def test_sizes_that_choose_the_way_change_no_class(spark, monkeypatch, small, shrink):
    monkeypatch.setattr(near_dedup, "_SMALL", small)
    monkeypatch.setattr(near_dedup, "_SHRINK", shrink)
    rng = random.Random(13)
    base, rows = [f"w{rng.randrange(300)}" for _ in range(90)], []
    for _ in range(90):
        base = list(base)
        base[rng.randrange(90)] = f"w{rng.randrange(300)}"
        rows.append((len(rows), " ".join(base)))
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == classes(rows)


def test_rows_not_ids_are_kept(spark):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(60))
    rows = [(1, text(1), "a"), (1, text(2), "b"), (2, text(2), "c"), (3, text(3), "d"), (3, text(3), "d"), (None, text(3), "e"), (None, text(4), "f"), (None, text(4), "f"), (7, None, "g"), (7, None, "g"), (8, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    kept = sorted((r.sha for r in near_dedup.keep_one(df).collect()))
    assert kept == ["a", "b", "d", "f", "g", "g", "h"]


def _ran(spark, f):
    """The final plans of what f runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    f()
    bus.waitUntilEmpty()
    found = store.executionsList(before, 10_000)
    return [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_links_that_are_stars_take_no_round(spark):
    star = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51)], "a long, b long")
    at = []
    assert len(_ran(spark, lambda: at.append(components(star)))) == 2
    assert {r[0]: r[1] for r in at[0].collect()} == {**{i: 1 for i in range(1, 40)}, 50: 50, 51: 50}


def test_small_tables_are_not_built_in_the_driver(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(20):  # families above _SMALL, so that all rounds run
            rows.append((len(rows), " ".join(w if rng.random() > 0.03 else f"w{rng.randrange(400)}" for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans = _ran(spark, lambda: near_dedup.near_duplicates(df))
    assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]


def test_the_pairs_of_one_pivot_are_dealt_out(spark):
    tables = near_dedup.Tables(spark)
    rows = [(1, i, 3000) for i in range(2, 3002)] + [(2, 1, 5), (7, 8, 2), (8, 7, 2)]
    found = near_dedup._pairs(spark.createDataFrame(rows, "x long, y long, n long"), spark.createDataFrame([(2, 9), (3, 1)], "x long, y long"), tables)
    parts = {}
    for x, y, part in found.collect():
        parts.setdefault((x, part), []).append(tuple(sorted((x, y))))
    assert max(map(len, parts.values())) <= 2 * near_dedup._PART
    assert sorted(sum(parts.values(), [])) == sorted([(1, i) for i in range(2, 3002) if i != 3] + [(7, 8)])
    sets = spark.createDataFrame([(i, 8, bytes([i % 50, *[0] * 7])) for i in range(1, 3002)], "node long, size long, set binary")
    links = near_dedup._verified(found, sets, 0.8)
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(1, i) for i in range(51, 3002, 50)]
    tables.drop()
