"""Byte-level BPE with a sentencepiece model that is serialised from a rank file.

Every byte is written as a printable letter, so each token of the rank file is a string; the model's pieces are those
strings in order of rank, a piece's score is its rank, negated, and normalisation is the identity. sentencepiece then merges
the adjacent pair of highest score, the first of equals, which is the merge of lowest rank. Texts are cut into pre-tokens
by a pattern before that; a pre-token that is itself a token is that token. Decoding maps the pieces' letters back.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_path
from .word_tokens import _Recent, byte_letters

#: Kinds of pieces and of models, in sentencepiece's protocol.
NORMAL, UNKNOWN, BPE = 1, 2, 2
KEPT = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[k] for k in range(len(found))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model: pieces (string, score, kind), then the trainer's and the normaliser's settings.

    One piece of unknown kind, which sentencepiece asks for, comes last; bytes are all tokens, so it is never used.
    """
    letters = byte_letters()
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(k)) + _field(3, NORMAL) for k, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    n = len(tokens)
    minus_one = (1 << 64) - 1
    trainer = _field(3, BPE) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, minus_one) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        self.letters = byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(k)) for k in range(len(tokens))]
        self.ranks = {t: k for k, t in enumerate(self.tokens)}
        self.kept = _Recent(self._piece, KEPT)
        self.piece = self.kept.__getitem__

    def _piece(self, text: str) -> bytes:
        data = text.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self.model.encode_as_ids(data.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.piece, self.split(text or ""))), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and ids (array of int).

    A null or empty text has no ids. Repeated rows and null ids are kept; an empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = byte_bpe(path, pattern).encode
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.concatenate([np.empty(0, "<u4"), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id, ids and decoded (bytes). Null ids decode to no bytes; an id that is no token raises."""
    rows = encoded.select(F.col(id_col), F.col(ids_col)).toDF("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = byte_bpe(path, pattern).decode
        for batch in batches:
            found = pa.array([of(ids.values.to_pylist() if ids.is_valid else []) for ids in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from public_tokenizers import PATTERN

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    found = decode(encode(table(spark, sf_dir, "documents"), path, PATTERN), path, PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
