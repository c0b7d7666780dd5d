"""Digests against a plain version, and rows against a loop over the documents."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from heptagrid.llm import fingerprints as f
from heptagrid.llm.common import table


def plain_places(data):
    """Selected windows, window by window."""
    ranks = []
    for i in range(len(data) - f.WINDOW + 1):
        w = data[i : i + f.WINDOW]
        total = sum(int(f.STEP[: w.count(bytes([b]))].sum()) for b in set(w))
        assert abs(total / (1 << 16) - sum(w.count(bytes([b])) * math.log2(w.count(bytes([b]))) for b in set(w))) < 0.01
        ranks.append(int(f.RANK[(f.FULL - total) * 1000 // f.FULL]))
    points = [0] * len(ranks)
    for i in range(max(1, len(ranks) - f.POPULAR + 1)):
        part = ranks[i : i + f.POPULAR]
        if part and min(part) < f.NO_RANK:
            points[i + part.index(min(part))] += 1
    return [i for i, p in enumerate(points) if p >= f.POINTS] or [i for i, p in enumerate(points) if p]


def test_selected_windows():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abcdefgh ,.") for _ in range(n)) for n in (64, 65, 100, 127, 128, 500, 900)] + [b"a" * 300, b"x" * 64]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    got = f._selected(data, starts, sizes)
    want = [s + i for s, t in zip(starts.tolist(), texts) for i in plain_places(t)]
    assert got.tolist() == want


def test_digests_dont_depend_on_neighbours():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij klmno.é") for _ in range(n)).encode() for n in (0, 3, 70, 0, 5000, 63, 200, 40_000, 0)]
    together = f.digests(texts)
    assert [d.text() for d in together] == [f.digests([t])[0].text() for t in texts]
    assert len(together[7].filters) > 1 and together[0].text() == "0:0:"
    assert all(f.likeness(d, d) == 1 for d in together)
    assert f.likeness(together[0], together[4]) == 0


def test_likeness_orders_edits():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randrange(2, 9)))
    for n in (300, 3000):
        a, b = [word() for _ in range(n)], [word() for _ in range(n)]
        d = [f.digests([" ".join(x).encode()])[0] for x in (a, a[: n * 9 // 10] + b[: n // 10], a[: n // 2] + b[: n // 2], b)]
        near = [f.likeness(d[0], x) for x in d]
        assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.15 and near[2] > 0.3


def wanted(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    out = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = f.digests([t.encode(), e.encode(), u.encode()])
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), a.text(), b.text(), f.likeness(a, b), f.likeness(a, c)))
    return sorted(out)


def test_op4(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = f.op4_fingerprints(spark, sf).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == wanted(rows)
    pairs = [(r.near_edited, r.near_next) for r in got if r.n_chars > 500]
    assert np.mean([a > b for a, b in pairs]) > 0.95


def test_odd_rows(spark):
    rows = [(5, None), (2, ""), (2, "short"), (2, "short"), (None, "no id " * 30), (9, "word and more " * 5000), (7, "é" * 101), (-4, "minus " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("id", "key", "bucket", "last")})
    assert sorted((str(r[0]), *r[1:]) for r in f.compare_with_next(docs).collect()) == wanted(rows)
    assert f.compare_with_next(docs.limit(0)).count() == 0 and f.fingerprints(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 9")
    assert [r.near_next for r in f.compare_with_next(alone).collect()] == [1.0]
    assert f.fingerprints(docs).columns == ["doc_id", "fingerprint"]
