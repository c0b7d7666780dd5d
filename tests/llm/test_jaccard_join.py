"""Components against all pairs of documents."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heptagrid.llm import common, components as joined
from heptagrid.llm import jaccard_join as j
from heptagrid.llm.common import table
from heptagrid.llm.components import components


def plain_set(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def plain(rows, percent=85, words=4):
    sets = [plain_set(t, words) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for k in by_size[x + 1 :]:
            if len(sets[i]) * 100 < percent * len(sets[k]):
                break
            both = len(sets[i] & sets[k])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                at[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(spark, rows, percent=85, words=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("id", "class", "n", "token")})
    return sorted((tuple(r) for r in j.jaccard_components(docs, percent, words=words).collect()), key=str)


def chain(seed):
    """Copies edited again and again, a shared passage, exact copies, and what has few words or none."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(25):
        text = [word() for _ in range(rng.choice((5, 30, 120, 400)))] + passage * rng.randrange(2)
        for _ in range(rng.choice((1, 2, 12))):
            rows.append(" ".join(text))
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
    rows += rows[:7] + ["a b", "A  b", "a b c", "", " \n", None, None, "one", "É a", "é a"]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(3, "a b"), (None, rows[0]), (None, "only this text without an id"), (5, "word " * 20000)]


def test_all_pairs(spark, monkeypatch):
    assert got(spark, chain(1)) == plain(chain(1))
    rows = chain(2)
    for name, value in (("LEAF", 4), ("TREE", 8), ("NAME_BITS", 3), ("FREQUENT", 4), ("FILTER_MOST", 0)):
        monkeypatch.setattr(j, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert got(spark, rows, percent=60) == plain(rows, 60)


def test_op9(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted((tuple(r) for r in j.op9_jaccard_join(spark, sf).collect()), key=str) == plain(rows)


def test_empty_and_one_of_each(spark):
    assert got(spark, []) == []
    rows = chain(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1))
    kept = j.one_of_each(docs, percent=85, words=4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in plain(rows)}


def test_five_words_and_four_fifths_unless_asked(spark):
    rows = chain(4)
    assert plain(rows, 80, 5) != plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in j.jaccard_components(docs).collect()), key=str) == plain(rows, 80, 5)
    assert {r.doc_id for r in j.one_of_each(docs).collect()} == {c for _, _, c in plain(rows, 80, 5)}


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (1200, 64)).astype(np.uint8)
    points[600:] = points[:600] + (rng.random((600, 64)) < 0.05)
    n, block = points.sum(1, dtype=np.int64), np.concatenate([rng.integers(0, 40, 600)] * 2)
    tree, seen = j.RTree(block, n, points), {}
    assert len(tree.levels) == 3 and sorted(tree.order) == list(range(1200))
    for m in (64, 16):
        asked = j.folded(points, m)
        query, place, over = tree.search(block, n, asked, 85, seen)
        got = set(zip(query.tolist(), place.tolist()))
        want = set()
        for k in range(1200):
            sums = np.minimum(asked, asked[k]).sum(1) - j.needed(n + n[k], 85)
            fits = (block == block[k]) & (sums >= 0) & (100 * np.minimum(n, n[k]) >= 85 * np.maximum(n, n[k]))
            want |= {(k, x) for x in np.flatnonzero(fits).tolist()}
        assert got == want
    assert all((np.diff(seen[k]) <= 0).all() for k in range(3))


def test_tree_pairs_of_other_labels_and_best():
    rng = np.random.default_rng(3)
    points = [rng.poisson(2, 64 << (k % 2)).astype(np.uint8) for k in range(60)]
    points += [p + (rng.random(len(p)) < 0.02).astype(np.uint8) for p in points for _ in range(6)]
    n = np.array([int(p.sum()) for p in points])
    block, classes, labels, guest = rng.integers(0, 3, 420), np.arange(1000, 1420), rng.integers(0, 9, 420), rng.random(420) < 0.5
    points = [p.tobytes() for p in points]
    ok = lambda x, y: 100 * min(n[x], n[y]) >= 85 * max(n[x], n[y]) and j.most_shared(points[x], points[y]) >= j.needed(n[x] + n[y], 85)
    want = {
        (x + 1000, y + 1000) for x in np.flatnonzero(guest).tolist() for y in np.flatnonzero(~guest).tolist()
        if block[x] == block[y] and labels[x] != labels[y] and ok(x, y)
    }
    got = lambda best: {tuple(p) for p in j.tree_pairs(block, classes, labels, n, points, guest, 85, best).tolist()}
    assert got(0) == want and len(want) > 100
    few = got(1)
    assert few <= want and {x for x, _ in few} == {x for x, _ in want}


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.sort(rng.choice(every, n, replace=False)) for n in (1, 60, 130, 150, 260, 300, 2000, 2300)]
    for x, y in itertools.product(sets, sets):
        overlap = len(np.intersect1d(x, y))
        assert overlap <= j.most_shared(j.point_of(x).tobytes(), j.point_of(y).tobytes()) <= min(len(x), len(y))
    assert [j.groups_of(n) for n in (1, 128, 129, 256, 257, 5000)] == [64, 64, 128, 128, 256, 4096]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (200, 400), (7, 7), (500, 500)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | dict.fromkeys((100, 200, 300, 400), 100)


def test_components_rounds(spark, monkeypatch):
    """Tasks that hold few links at once leave chains, repeats and a node of many links to the rounds."""
    monkeypatch.setattr(joined, "ROOM", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rng = random.Random(3)
        edges = [(i, i + 1) for i in range(-40, 0)] + [(900, k) for k in range(800, 840)] + [(i, i + 1) for i in range(800, 810)] * 2
        edges += [(7, 7), (1 << 62, -(1 << 62))]
        rng.shuffle(edges)
        found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: -40 for i in range(-40, 1)} | {i: 800 for i in (*range(800, 840), 900)} | dict.fromkeys((1 << 62, -(1 << 62)), -(1 << 62))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars():
    rng = np.random.default_rng(5)
    for _ in range(200):
        u, v = rng.integers(-30, 30, (2, rng.integers(1, 50)))
        least = {k: k for k in (*u.tolist(), *v.tolist())}
        for _ in least:
            for x, y in zip(u.tolist(), v.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        nodes, low = joined.stars(u, v)
        assert dict(zip(nodes.tolist(), low.tolist())) == {k: m for k, m in least.items() if k != m}


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    many = spark.createDataFrame([(k % 3, k) for k in range(30)] + [(7, k) for k in range(50)] + [(None, 1), (8, 1)], "k long, x long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, y string")
    hot = common.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")))
    assert {r.k: r["__salts"] for r in hot.collect()} == {0: 4, 1: 4, 2: 4, 7: 17}
    for how in ("inner", "left"):
        got, want = common.salted_join(many, one, ["k"], hot, ["x"], how), many.join(one, ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert common.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")).where("n < 3")) is None


def test_needed():
    for n, p in itertools.product(range(1, 300), (60, 85, 100)):
        least = next(o for o in range(n + 1) if 100 * o >= p * (n - o))
        assert j.needed(n, p) == least
