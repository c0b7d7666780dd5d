"""Token-id files: length-delimited binary records with masked checksums, and an offset index beside them.

A file is a run of records, each framed as

    8 bytes  payload length, little-endian
    4 bytes  masked CRC-32C of those 8 bytes
    payload
    4 bytes  masked CRC-32C of the payload

the framing of record files that training programs read. A payload is one document's sequence: 1 byte for the width of an
id (2 where every id of the vocabulary fits, else 4; plus 128 where the document's id is null), 8 bytes for the document's
id, then the token ids, all little-endian. Files hold documents in ascending order of id; the index, a Parquet table, has
each record's file, offset and length, for reads in shuffled order.

Files are written by the executors under names that no other attempt uses, and the index, which is committed by Spark,
names only files of tasks that succeeded. So a lost executor or a second attempt leaves at most files that nothing names.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, table, tokenizer_path
from .crc32c import crc32c, masked
from .word_tokens import word_encoder

END_ID = 2
#: Payload bytes whose checksums are computed together.
GROUP_BYTES = 4 << 20
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<Bq")


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [n + struct.pack("<I", x) + p + struct.pack("<I", y) for n, x, p, y in zip(lengths, a, payloads, b)]


def read_frames(stream, group: int = GROUP_BYTES) -> Iterator[bytes]:
    """The payloads of a file in turn, with both checksums of each verified; a damaged or cut file raises ValueError."""

    def checked(heads: list[tuple[bytes, int]], bodies: list[bytes], sums: list[int]) -> list[bytes]:
        if masked(crc32c([h for h, _ in heads])).tolist() != [x for _, x in heads] or masked(crc32c(bodies)).tolist() != sums:
            raise ValueError("a record's checksum doesn't match")
        return bodies

    heads, bodies, sums, size = [], [], [], 0
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("the file ends within a record")
        n, check = HEAD.unpack(head)
        if masked(crc32c([head[:8]]))[0] != check if n > 1 << 30 else False:
            raise ValueError("a record's length is damaged")
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("the file ends within a record")
        heads.append((head[:8], check))
        bodies.append(body[:n])
        sums.append(struct.unpack("<I", body[n:])[0])
        size += n
        if size >= group:
            yield from checked(heads, bodies, sums)
            heads, bodies, sums, size = [], [], [], 0
    yield from checked(heads, bodies, sums)


def payload(doc: int | None, ids: bytes, width: int) -> bytes:
    head = KEY.pack(width | 128 * (doc is None), doc or 0)
    return head + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)


def payload_of(data: bytes) -> tuple[int | None, np.ndarray]:
    kind, doc = KEY.unpack_from(data)
    return (None if kind & 128 else doc), np.frombuffer(data, f"<u{kind & 127}", offset=KEY.size).astype("<u4")


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, write the record files to ``folder`` and the index to ``folder/index``; return the index.

    Index: doc id, file, first (the file's place in the order: its smallest id), at (position in the file), offset, n_bytes,
    start_in_file, n_tokens. A null or empty text is a record of the end id alone; rows with equal ids are neighbours, in
    order of their texts, and each has a record; null ids come first; an empty table has no file. Other columns, whatever
    their names, are not read. Ids are whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("file", T.StringType()), T.StructField("first", kind)]
        + [T.StructField(n, T.LongType()) for n in ("at", "offset", "n_bytes", "start_in_file", "n_tokens")]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        ids_of, end = encoder.ids, struct.pack("<I", end_id)
        width = 2 if max(encoder.library.get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        out, first, at, offset, start = None, None, 0, 0, 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done = 0
            while done < len(keys):
                payloads, counts, size, begin = [], [], 0, done
                while done < len(keys) and size < GROUP_BYTES:
                    ids = ids_of(texts[done].as_py()) + end
                    payloads.append(payload(keys[done].as_py(), ids, width))
                    counts.append(len(ids) // 4)
                    size += len(payloads[-1])
                    done += 1
                if out is None:
                    out, first = where.open_output_stream(f"{top}/{name}"), keys[0]
                records = frames(payloads)
                out.write(b"".join(records))
                sizes, counts = np.array([len(r) for r in records]), np.array(counts)
                n = len(records)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(begin, n),
                        pa.array([name] * n),
                        pa.array([first.as_py()] * n, keys.type),
                        pa.array(np.arange(at, at + n)),
                        pa.array(offset + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(start + np.cumsum(counts) - counts),
                        pa.array(counts),
                    ],
                    names=schema.names,
                )
                at, offset, start = at + n, offset + int(sizes.sum()), start + int(counts.sum())
        if out is not None:
            out.close()

    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return spark.read.schema(schema).parquet(f"{folder}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """A row per file: file, base (ids in all files before it). The window goes over files, not documents."""
    files = index.groupBy("file").agg(F.min("first").alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_records(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Read the files back: a row per record with id, start (ids of all records before it), n_tokens, value (the ids).

    Files are read side by side; within a file rows are in order. Sort by ``start`` for the order of all.
    """
    return _read(folder, index, "array<bigint>", lambda ids: ids.astype(np.int64))


def _read(folder: str, index: DataFrame, kind: str, make) -> DataFrame:
    files = file_starts(index)
    schema = f"id bigint, start bigint, n_tokens bigint, value {kind}"
    width = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_input_stream(f"{top}/{name}") as raw:
                    docs, counts, values, size = [], [], [], 0

                    def rows():
                        ends = np.cumsum(counts)
                        return pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs, pa.int64()),
                                pa.array(start + ends - counts),
                                pa.array(counts, pa.int64()),
                                pa.array(values, width),
                            ],
                            names=["id", "start", "n_tokens", "value"],
                        ), int(ends[-1])

                    for data in read_frames(io.BufferedReader(_Raw(raw), 1 << 20)):
                        doc, ids = payload_of(data)
                        docs.append(doc)
                        counts.append(len(ids))
                        values.append(make(ids))
                        size += len(ids)
                        if size >= 1 << 20:
                            out, n = rows()
                            yield out
                            start, docs, counts, values, size = start + n, [], [], [], 0
                    if counts:
                        yield rows()[0]

    # dealt round robin, so that a task has a file; a number given is not coalesced
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


class _Raw(io.RawIOBase):
    """A pyarrow stream as a Python raw stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, b):
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(spark, "records")
    index = write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    back = _read(folder, index, "bigint", crc_of_ids)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("value").alias("ids_crc32"))


def shuffled_read(folder: str, rows: DataFrame) -> DataFrame:
    """Records named by index rows, in the order of the given rows' partitions, by offset: id, ids."""
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.LongType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found, opened = [], {}
            for name, offset, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if name not in opened:
                    opened[name] = where.open_input_file(f"{top}/{name}")
                data = opened[name].read_at(n, offset)
                found.append(payload_of(next(read_frames(io.BytesIO(data))))[1].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "ids"])

    return rows.select("id", "file", "offset", "n_bytes").mapInArrow(read, schema)


__all__ = ["op1_token_records", "read_records", "shuffled_read", "write_records"]
