"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces of equal length are interchangeable, so packing is planned over the number of pieces of each length: at most
``capacity`` numbers, whatever the corpus. A bin is filled greedily, the longest piece that fits first; then its smallest
piece is taken out and replaced by the two unpacked pieces that fill the widened gap most tightly, if any two do better;
this goes on while it helps. The bin's pattern is applied as often as the counts allow. Pieces then take their places by
their rank among those of their length.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table, tokenizer_path
from .word_tokens import word_encoder

CAPACITY = 4096
END_ID = 1


def pieces_of(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, and task and nth, which number the pieces of a length in a task."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).toDF("id", "text")
    long = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "task", "nth")]
    schema = T.StructType([rows.schema["id"], T.StructField("piece", T.IntegerType()), *long])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, step = word_encoder(tokenizer).ids, struct.pack("<I", end_id), 4 * capacity
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            row, piece, length, crc, nth = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(np.array(piece, np.int64) * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(row), pa.int64()),
                    pa.array(nth, pa.int64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(cut, schema)


def _best_two(lengths: np.ndarray, counts: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """Two pieces, a >= b, with the largest a + b <= gap that is over ``more_than``. lengths: ascending, counts over 0."""
    a = lengths[: np.searchsorted(lengths, gap)]
    at = np.searchsorted(lengths, np.minimum(gap - a, a), side="right") - 1
    same = (at >= 0) & (lengths[at] == a) & (counts[: len(a)] < 2)
    at = at - same
    total = np.where(at >= 0, a + lengths[np.maximum(at, 0)], 0)
    if not len(total) or total.max() <= more_than:
        return None
    best = int(total.argmax())
    return int(a[best]), int(lengths[at[best]])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, ranks, first sequence, pieces a sequence, offset) and the number of sequences.

    The pieces of a length with ranks from the first on go to sequences from the first on, so many to each, side by side
    from the offset on.
    """
    left = dict(counts)
    order = sorted(n for n, c in left.items() if c > 0)
    taken: dict[int, int] = defaultdict(int)
    slots, sequences = [], 0
    while order:
        bin_: dict[int, int] = defaultdict(int)
        gap, i = capacity, len(order) - 1
        while i >= 0 and gap >= order[0]:
            n = order[i]
            if uses := min(left[n], gap // n):
                bin_[n] += uses
                gap -= uses * n
            i = min(i, bisect_right(order, gap)) - 1
        while gap and sum(bin_.values()) > 1:
            smallest = min(bin_)
            free = [n for n in order if left[n] > bin_.get(n, 0)]
            free_counts = np.array([left[n] - bin_.get(n, 0) for n in free], np.int64)
            two = _best_two(np.array(free, np.int64), free_counts, gap + smallest, smallest) if free else None
            if two is None:
                break
            bin_[smallest] -= 1
            if not bin_[smallest]:
                del bin_[smallest]
            for n in two:
                bin_[n] += 1
            gap += smallest - sum(two)
        times = min(left[n] // uses for n, uses in bin_.items())
        offset = 0
        for n, uses in sorted(bin_.items(), reverse=True):
            slots.append((n, taken[n], times * uses, sequences, uses, offset))
            offset += n * uses
            taken[n] += times * uses
            left[n] -= times * uses
        order = [n for n in order if left[n]]
        sequences += times
    return slots, sequences


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with ``end_id``, so a null or empty text is a piece of one token. Only documents over the capacity
    are cut. Repeated rows and equal ids are packed each; null ids are kept; an empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity
    slots, _ = plan(counts, capacity)
    table_ = np.array(sorted(slots), np.int64).reshape(-1, 6)
    keys = spark.sparkContext.broadcast((table_[:, 0] << 48 | table_[:, 1], table_))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    long = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    schema = T.StructType([pieces.schema["id"], T.StructField("piece", T.IntegerType()), *long])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, slot = keys.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            s = slot[np.searchsorted(first, length << 48 | rank, side="right") - 1]
            nth = rank - s[:, 1]
            sequence, offset = s[:, 3] + nth // s[:, 4], s[:, 5] + nth % s[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
