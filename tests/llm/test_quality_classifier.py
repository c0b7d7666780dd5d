"""Held-out accuracy, and the vote against a loop."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from heptagrid.llm import quality_classifier as q
from heptagrid.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    found = q.op6_quality_classifier(spark, SF)
    rows = found.collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) >= 5 and auc > 0.95
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.93
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_held_out_labels_are_not_learnt(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(q.fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train(docs, x) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_words_tell_texts_of_the_same_marks_apart():
    """Texts that have the same characters' kinds, word lengths and repeats, and differ in their words alone."""
    rng = np.random.default_rng(0)
    vocabularies = [["%s%s" % (a, b) for a in "abcdefgh" for b in x] for x in ("klmn", "opqr")]
    texts = [" ".join(rng.choice(vocabularies[k % 2], 80)) + "." for k in range(120)]
    rows, labels = [q.terms(t) for t in texts], np.arange(120) % 2
    model = q.fit(rows[:80], labels[:80])
    scores = q.vote(model, np.array([q._project(model.axes, *r) for r in rows[80:]], np.float32))
    assert ((scores > 0.5) == labels[80:]).all()


def test_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(1)
    used = np.sort(rng.choice(q.TERMS, 60, replace=False))
    rows = []
    for k in range(40):  # four kinds of texts, so four large singular values
        own = np.unique(np.concatenate([used[15 * (k % 4) : 15 * (k % 4) + 15], rng.choice(used, 2)]))
        rows.append((own, rng.integers(1, 4, len(own))))
    model = q.fit(rows, np.zeros(40), axes=4)
    x = np.zeros((40, q.TERMS))
    for k, (t, c) in enumerate(rows):
        x[k, t] = np.log1p(c)
    rarity = np.log(41 / (1 + (x > 0).sum(0))) + 1
    rarity[q.TERMS - q.HASHED :] *= q.WORD_WEIGHT
    x = x[:, used] * rarity[used]
    v = np.linalg.svd(x / np.linalg.norm(x, axis=1, keepdims=True), full_matrices=False)[2][:4].T
    got = model.axes[used] / rarity[used][:, None]
    assert np.abs(got @ got.T - v @ v.T).max() < 1e-2
    near = x @ v / np.linalg.norm(x @ v, axis=1, keepdims=True)
    assert np.abs(model.vectors @ model.vectors.T - near @ near.T).max() < 1e-2


def test_one_id_labelled_and_repeated(spark):
    docs = spark.createDataFrame([(2, "same text"), (2, "same text"), (2, "other, text!")] * 50 + [(4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int")
    model = q.train(docs, labels)
    assert sorted(model.labels.tolist()) == [0, 1]


def test_vote_is_the_loop(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.train(docs, labels)
    got = {r.doc_id: r.score for r in q.quality_scores(docs, model).collect()}
    for r in docs.limit(40).collect():
        v = q._project(model.axes, *q.terms(r.text))
        cos = sorted(((float(v @ w) / max(np.linalg.norm(v), 1e-9), y) for w, y in zip(model.vectors, model.labels)), key=lambda x: -x[0])[: q.NEIGHBOURS]
        weight = [max(c, 0) ** q.POWER for c, _ in cos]
        assert abs(got[r.doc_id] - sum(w * y for w, (_, y) in zip(weight, cos)) / sum(weight)) < 1e-3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "good words here."), (2, "good words here."), (None, "bad*** x$$$ y&&&"), (3, "bad%%% z### " * 50000), (4, "The end. Of it.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("id", "score", "label", "terms")})
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (4, 1), (None, 1), (9, None), (77, 1)], "doc_id long, quality int")
    model = q.train(docs, labels)
    got = q.quality_scores(docs, model).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id == 2}) <= 2
    assert {r.score for r in got if r.doc_id == 1} == {model.prior}
    assert q.quality_scores(docs.limit(0), model).count() == 0
    nothing = q.train(docs, labels.limit(0))
    assert {r.score for r in q.quality_scores(docs, nothing).collect()} == {0.5}
    assert q.keep_predicted(docs, model).columns == docs.columns
