"""The stages against plain versions of each, and the driver's guard."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from heptagrid.llm import quality_classifier as q
from heptagrid.llm.common import table

from .test_jaccard_join import plain as plain_components
from .test_quality_rules import plain as plain_counts
from .test_tokens import library, packing_is_sound  # noqa: F401


def test_stages_and_run(spark, sf, library):  # noqa: F811
    docs = table(spark, sf, "documents")
    after = [docs]
    for _, stage in p.STAGES[:3]:
        after.append(stage(spark, after[-1], sf).cache())
        assert after[-1].schema.fieldNames() == docs.schema.fieldNames()
    texts = [{r.doc_id: r.text for r in d.collect()} for d in after]
    assert set(texts[1]) <= {d for d, t in texts[0].items() if not plain_counts(t)[5]}
    model = q.train(after[1], table(spark, sf, "labels"))
    scores = q.vote(model, np.array([q._project(model.axes, *q.terms(t)) for t in texts[1].values()], np.float32))
    assert set(texts[2]) == {d for d, s in zip(texts[1], scores) if s >= q.THRESHOLD}
    assert set(texts[3]) == {c for _, _, c in plain_components(list(texts[2].items()))}
    got = p.run(spark, sf).collect()
    n, least = packing_is_sound(got, list(texts[3].items()), library)
    assert n <= least + 1
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    good = [d for d, t in texts[0].items() if labels.get(d) == 1 and not plain_counts(t)[5]]
    assert np.mean([d in texts[2] for d in good]) > 0.97


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_extra_columns_ride_along(spark, sf):
    docs = table(spark, sf, "documents").withColumns({n: F.lit(1) for n in ("id", "class", "kept", "n")})
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-4:] == ["id", "class", "kept", "n"]


@pytest.mark.parametrize("name", ["op1_token_records", "op9_jaccard_join", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


def five_word_components(rows, percent=80):
    """Each id's least reachable id, by all pairs of the sets of five-word shingles."""
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    label = [d for d, _ in rows]
    for (i, x), (k, y) in itertools.combinations(enumerate(sets), 2):
        if x and y and label[i] != label[k] and 100 * len(x & y) >= percent * len(x | y):
            old, new = max(label[i], label[k]), min(label[i], label[k])
            label = [new if v == old else v for v in label]
    return {d: c for (d, _), c in zip(rows, label)}


def test_near_duplicates_by_five_words(spark, sf):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    for n in (30, 49, 50, 51, 60, 300):  # a word changed: at 50, 41 / 51 by five words and 43 / 51 by four
        text = ["w%d" % rng.randrange(10**6) for _ in range(n)]
        for _ in range(4):
            rows.append((10**6 + len(rows), " ".join(text)))
            text[rng.randrange(8, n - 8)] = "w%d" % rng.randrange(10**6)
    rows += [(2 * 10**6 + k, t) for k, t in enumerate(("a b c d", "A b  c d", "a b c", "", None))]
    found = five_word_components(rows)
    assert {d for d, c in found.items() if d == c} != {c for _, _, c in plain_components(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = p.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in found.items() if d == c)
