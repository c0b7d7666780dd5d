"""Similarity digests of documents from improbable features.

A feature is a window of WINDOW bytes. Its entropy gives its rank: the rarer such an entropy is in plain text, by a normal
law whose mean and deviation are parameters, the better; windows of almost no entropy have no rank. Of every POPULAR
neighbouring windows the best, the first of equals, gets a point, and windows with at least POINTS points are selected.
Selected features are hashed, in order, without repeats, into a chain of Bloom filters of FILTER_BITS bits, BITS bits each,
at most FEATURES a filter. Two digests are compared by the bits that their filters share, less those expected by chance.

Entropies are exact: counts of equal bytes within a window's reach change a window's sum of whole numbers as it moves on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WINDOW = 64
POPULAR = 64
POINTS = 16
FILTER_BITS = 2048
BITS = 5
FEATURES = 160
#: Entropy in thousandths of the most that a window can have: of plain text, and the least that is worth a rank.
MEAN, DEVIATION, LEAST = 690, 35, 150
CHUNK = 1 << 18
NO_RANK = 1 << 20
LOWEST = -(1 << 63)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What one more equal byte adds to a window's sum, in fixed point, and the rank by thousandths of entropy."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    sums = np.rint(c * np.log2(np.maximum(c, 1)) * (1 << 16)).astype(np.int64)
    e = np.arange(1001)
    density = np.exp(-0.5 * ((e - MEAN) / DEVIATION) ** 2)
    rank = np.argsort(np.argsort(density, kind="stable"), kind="stable")
    rank[e < LEAST] = NO_RANK
    return np.diff(sums), rank


STEP, RANK = _tables()
FULL = int(WINDOW * np.log2(WINDOW) * (1 << 16))


class Digest(NamedTuple):
    #: (filters, FILTER_BITS / 8) bytes, and the number of features
    filters: np.ndarray
    features: int

    def text(self) -> str:
        return f"{len(self.filters)}:{self.features}:{self.filters.tobytes().hex()}"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _ranks(data: np.ndarray) -> np.ndarray:
    """The rank of the window at each place; data has WINDOW bytes at least."""
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[: n - k] += same
        behind[k:] += same
    first = np.bincount(data[:WINDOW])
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = sum(int(STEP[:c].sum()) for c in first)
    total[1:] = STEP[behind[WINDOW:]] - STEP[ahead[: n - WINDOW]]
    np.cumsum(total, out=total)
    return RANK[(FULL - total) * 1000 // FULL]


def _selected(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of selected windows in texts that lie side by side; no window reaches over a text's end."""
    rank = _ranks(data)
    valid = np.zeros(len(data), bool)
    one = np.zeros(len(data) + 1, np.int8)
    long = sizes >= WINDOW
    np.add.at(one, starts[long], 1)
    np.add.at(one, starts[long] + sizes[long] - WINDOW + 1, -1)
    valid = np.cumsum(one[:-1]).astype(bool)
    key = np.full(len(data) + POPULAR, NO_RANK << 40, np.int64)
    key[: len(rank)] = rank << 40
    key[: len(data)][~valid] = NO_RANK << 40
    key |= np.arange(len(key))
    best, width = key, 1
    while width < POPULAR:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    # whole neighbourhoods of a text's windows; a text with fewer windows has one, which ends in places without rank
    one[:] = 0
    np.add.at(one, starts[long], 1)
    np.add.at(one, starts[long] + np.maximum(sizes[long] - WINDOW + 1 - POPULAR + 1, 1), -1)
    best = best[: len(data)][np.cumsum(one[:-1]).astype(bool)]
    best = best[best >> 40 < NO_RANK] & ((1 << 40) - 1)
    points = np.bincount(best, minlength=len(data))
    chosen = points >= POINTS
    at = np.flatnonzero(points)
    # a text in which no window has points enough: its best few
    owner = np.searchsorted(starts, at, side="right") - 1
    has = np.bincount(np.searchsorted(starts, np.flatnonzero(chosen), side="right") - 1, minlength=len(starts))
    chosen[at[has[owner] == 0]] = True
    return np.flatnonzero(chosen)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.stack([(hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1) for k in range(BITS)], 1)


def _digest(hashes: np.ndarray) -> Digest:
    first = np.sort(np.unique(hashes, return_index=True)[1])
    n = len(first)
    filters = -(-n // FEATURES)
    bits = np.zeros(filters * FILTER_BITS, bool)
    bits[(np.arange(n)[:, None] // FEATURES * FILTER_BITS + _bits(hashes[first])).ravel()] = True
    return Digest(np.packbits(bits).reshape(filters, FILTER_BITS // 8), n)


def digests(texts: list[bytes]) -> list[Digest]:
    """The digest of each text. A text without a ranked window has one feature, itself; an empty one has none."""
    out: list[Digest] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        sizes = np.array([len(t) for t in group])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(group), np.uint8)
        places, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
        if size >= WINDOW:
            # empty texts begin where the next one does, which must own the place
            real = np.flatnonzero(sizes)
            places = _selected(data, starts[real], sizes[real])
            words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].view("<u8").reshape(-1, WINDOW // 8)
            hashes = np.full(len(places), 0x1F83D9ABFB41BD6B, np.uint64)
            for k in range(WINDOW // 8):
                hashes = _mix(hashes ^ words[:, k])
            hashes = _mix(hashes)
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + sizes)
        for text, a, b in zip(group, low.tolist(), high.tolist()):
            own = hashes[a:b]
            if a == b and text:
                own = np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8").astype(np.uint64)
            out.append(_digest(own))
        at = end
    return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, the same both ways; 1 for equal digests, and 0 where one has no features and the other has some."""
    if a.features == b.features and np.array_equal(a.filters, b.filters):
        return 1.0
    if not a.features or not b.features:
        return 0.0
    if len(a.filters) != len(b.filters):
        return _onto(*sorted((a, b), key=lambda d: len(d.filters)))
    return (_onto(a, b) + _onto(b, a)) / 2


def _onto(a: Digest, b: Digest) -> float:
    """For each filter of a the best match among those of b, weighted by features."""
    size = np.bitwise_count(b.filters).sum(1, dtype=np.int64)
    total = 0.0
    for k, f in enumerate(a.filters):
        own = int(np.bitwise_count(f).sum(dtype=np.int64))
        shared = np.bitwise_count(b.filters & f).sum(1, dtype=np.int64)
        chance, most = own * size / FILTER_BITS, np.minimum(own, size)
        score = (np.maximum(shared - chance, 0) / np.maximum(most - chance, 1e-9)).max()
        total += min(1.0, float(score)) * min(FEATURES, a.features - k * FEATURES)
    return total / a.features


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and fingerprint, a string: filters, features, and the filters' bits in hex.

    A null text counts as empty. Equal texts have equal fingerprints. Repeated rows and null ids are kept; an empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d.text() for d in digests([t.as_py().encode() for t in batch.column(1)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _bucket(key: Column, cuts: np.ndarray) -> Column:
    """How many cuts, in ascending order, are at or below the key; only the key goes through Python."""

    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return find(key)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, last, key, text, sorted within partitions: documents in order of id, and after each bucket, with last = 1,
    the document that follows it.

    Buckets are ranges of ids, which an exchange of the ids alone finds; so one exchange of the texts puts neighbours together,
    and only a bucket's first document is sent twice. Null ids come first; equal ids go by their texts, and are one bucket.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    cuts = np.unique(np.array([r["key"] for r in ranged.collect()], np.int64))  # no more than n
    bucketed = rows.select(_bucket(F.col("key"), cuts).alias("bucket"), F.lit(0).alias("last"), "key", "text")
    least = bucketed.groupBy("bucket").agg(F.min("key").alias("key"))
    before = F.lag("bucket").over(W.orderBy("bucket"))  # over buckets, not documents
    least = least.withColumn("before", F.coalesce(before, F.max("bucket").over(W.partitionBy())))
    heads = bucketed.join(F.broadcast(least), ["bucket", "key"]).groupBy("before", "key").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("before").alias("bucket"), F.lit(1).alias("last"), "key", "text")
    return bucketed.union(heads).repartition("bucket").sortWithinPartitions("bucket", "last", "key", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many, or all, of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return compare_with_next(table(spark, sf_dir, "documents"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; rows as :func:`fingerprints` treats them."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for the one after it
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            rows = [(*r, d) for r, d in zip(rows, digests([t.encode() for _, _, t in rows]))]
            if held is not None:
                rows.insert(0, held)
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[0]]
            held = rows[-1] if rows else held
            changed = [edited(x[2], y[2]).encode() for x, y in pairs]
            found = digests(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if x[1] == LOWEST else x[1] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                    pa.array([x[3].text() for x, _ in pairs], pa.string()),
                    pa.array([d.text() for d in found], pa.string()),
                    pa.array([likeness(x[3], d) for (x, _), d in zip(pairs, found)], pa.float64()),
                    pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
                ],
                names=names,
            )

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
