"""Quality by nearest-neighbour voting in a latent space.

A text's terms are the trigrams of its character kinds, runs of a kind taken once, marks of words that repeat, and its words
and pairs of words, hashed into HASHED terms, which count WORD_WEIGHT as much. Counts are damped, weighted by rarity among the labelled texts and scaled to length one; the leading right singular vectors of the
labelled texts' matrix are the axes of the latent space. The labelled vectors, SAMPLE at most, are broadcast; of every
document the cosines with all of them are computed exactly, a block of documents at a time, and the nearest vote with their
labels, weighted by a power of their similarity.

Fitting takes a sample of the labelled rows, whose bound is a parameter: those with the smallest hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 3000
AXES = 32
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.3
BLOCK = 256
FOLDS = 5
#: Characters that are a kind of their own; other kinds are lower case, upper case, digits, blanks, line ends, bytes over 127, others.
OWN_KINDS = ".,!?;:'\"()|#*$%&<>-_/="
KINDS = 7 + len(OWN_KINDS)
MARKS = 8
#: Terms that words and pairs of words share by their hashes, and the weight of these beside the others.
HASHED, WORD_WEIGHT = 1 << 13, 0.5
TERMS = KINDS**3 + MARKS + HASHED
PAIR = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, np.int32)
    kind[128:] = 5
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r")):
        kind[[ord(c) for c in chars]] = k
    kind[[ord(c) for c in OWN_KINDS]] = 7 + np.arange(len(OWN_KINDS))
    return kind


KIND = _kinds()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the whole text, ascending, and how often each occurs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kind = KIND[np.frombuffer(data, np.uint8)]
    if len(kind):
        kind = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
    grams = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
    words = data.lower().split()
    counts = np.bincount(grams, minlength=TERMS)
    if words:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        marks = counts[KINDS**3 : KINDS**3 + MARKS]
        for k in (1, 2, 3):
            marks[k - 1] = (h[k:] == h[:-k]).sum()
        distinct = len(np.unique(h))
        marks[3], marks[4] = distinct, len(h) - distinct
        pairs = (h[1:] * PAIR) ^ h[:-1]
        marks[5] = len(pairs) - len(np.unique(pairs))
        slots = (np.concatenate([h, pairs * PAIR]) >> np.uint64(40)).astype(np.int64) % HASHED
        counts[KINDS**3 + MARKS :] = np.bincount(slots, minlength=HASHED)
    found = np.flatnonzero(counts)
    return found, counts[found]


class Model(NamedTuple):
    """axes: (TERMS, AXES), rarity included; vectors: the labelled ones, of length one; labels; prior: their mean."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, axes: int = AXES, seed: int = 0) -> Model:
    """Weights, axes by subspace iteration, and the labelled texts' vectors. Rows in a fixed order give a fixed model."""
    n = len(rows)
    used = np.unique(np.concatenate([np.empty(0, np.int64), *[t for t, _ in rows]]))
    at = np.zeros(TERMS, np.int64)
    at[used] = np.arange(len(used))
    x = np.zeros((n, len(used)), np.float32)
    for k, (t, c) in enumerate(rows):
        x[k, at[t]] = np.log1p(c)
    rarity = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    rarity[used >= TERMS - HASHED] *= WORD_WEIGHT
    x = _unit(x * rarity)
    k = min(axes, n, len(used))
    q = np.random.default_rng(seed).standard_normal((len(used), k)).astype(np.float32)
    for _ in range(8):
        q = np.linalg.qr(x.T @ (x @ q))[0] if k else q
    full = np.zeros((TERMS, k), np.float32)
    full[used] = q * rarity[:, None]
    vectors = _unit(np.array([_project(full, t, c) for t, c in rows], np.float32).reshape(n, k))
    return Model(full, vectors, labels.astype(np.float32), float(labels.mean()) if n else 0.5)


def _project(axes: np.ndarray, t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.log1p(c).astype(np.float32) @ axes[t]


def vote(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """The weighted vote for each vector; without a neighbour of positive cosine, the labels' mean."""
    k = min(neighbours, len(model.labels))
    if not k:
        return np.full(len(vectors), model.prior)
    out = []
    for at in range(0, len(vectors), BLOCK):
        cosines = _unit(vectors[at : at + BLOCK]) @ model.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** power
        total = weight.sum(1)
        out.append(np.divide((weight * model.labels[near]).sum(1), total, out=np.full(len(total), model.prior), where=total > 0))
    return np.clip(np.concatenate([np.empty(0), *out]), 0, 1)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows outside fold 0. An id that is labelled more than once has the mean of its labels, and of documents
    with one id the one whose terms come first in order counts; rows without an id or label, or without a document, are left
    out. So no more than ``sample`` rows are collected."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.where(fold("id") != 0).groupBy("id").agg(F.avg("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # SAMPLE rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(1)]
            kinds = pa.list_(pa.int32())
            lists = [pa.array([f[k].astype(np.int32) for f in found], kinds) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["id", "label", "terms", "counts"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.select("id", "text", "label").mapInArrow(count, f"id {kind}, label double, terms array<int>, counts array<int>")
    # documents with one id meet on the map side, so a third of all rows with one id are a row a task after that
    first = counted.groupBy("id", "label").agg(F.min(F.struct("terms", "counts")).alias("t")).select("id", "label", "t.terms", "t.counts").collect()
    first = sorted(first, key=lambda r: r["id"])
    return fit([(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in first], np.array([r["label"] for r in first]))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    vectors = np.array([_project(model.axes, *terms(t.as_py())) for t in texts], np.float32)
    return vote(model, vectors.reshape(len(texts), model.axes.shape[1]))


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, score (0 to 1), predicted (1 where the score reaches the threshold, else 0).

    The whole text counts. A null or empty text has no terms, and the labels' mean as score. Equal texts have equal
    scores. Repeated rows and null ids are kept; an empty table gives an empty result; without labels every score is 0.5.
    Other columns, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["id", "score", "predicted"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_predicted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns. A null or empty text has the labels' mean as score;
    equal texts stay or go together; an empty table gives an empty result."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), sent.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return quality_scores(docs, model).select("doc_id", held_out, "score", "predicted")
