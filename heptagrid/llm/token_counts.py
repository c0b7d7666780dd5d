"""Token counts with a digest cache.

A text's key is the digest of its normalised content with the digest of the tokenizer's file. Counts are looked up in a
Parquet table, which has a folder for each tokenizer; of the keys that it lacks, one text each is encoded, and the new counts
are appended to the table. What the table has is first brought down to the contents asked for, so a small batch moves little
of a large table.

Normalisation may not change a count: for a tokenizers file whose normaliser turns runs of white space into one space and
whose pre-tokeniser drops white space, runs of blanks, tabs and line ends become one space and the ends are trimmed; for
any other file a text is its own normal form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hot_keys, salted_join, staged, table, tokenizer_path
from .word_tokens import digest_of_file, word_encoder

LIMIT = 2048
#: Missing contents, 32 bytes each, that are sent to all tasks; more are joined by key.
SENT = 100_000
CACHE_SCHEMA = "content binary, n_tokens bigint, tokenizer string"


def counter(path: str):
    """text -> count, by the library that the file belongs to."""
    if path.endswith(".json"):
        ids = word_encoder(path).ids
        return lambda text: len(ids(text)) // 4
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    raise ValueError(f"no library for {path}")


def normal_form(text: Column, path: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".json") and word_encoder(path).by_word:
        return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return text


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, over_limit. ``cache``: a Parquet path in a shared folder.

    A null text counts as empty (0, 0, false). Repeated rows are each returned; equal contents are encoded once. Null ids
    are kept. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    spark, version = docs.sparkSession, digest_of_file(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("__text")).toDF("__id", "__text")
    content = F.unhex(F.sha2(normal_form(F.col("__text"), tokenizer), 256))
    keyed = staged(rows.select("__id", F.octet_length("__text").cast("long").alias("n_bytes"), content.alias("content")), "keys")
    copies = staged(keyed.groupBy("content").agg(F.count("*").alias("n")), "contents")

    def known() -> DataFrame:
        """content, __n: the counts of the batch's contents that the table has; two runs that append one key agree on it."""
        try:
            stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = spark.createDataFrame([], CACHE_SCHEMA)  # no table yet
        stored = stored.where(F.col("tokenizer") == version).join(copies, "content", "left_semi")
        return stored.groupBy("content").agg(F.max("n_tokens").alias("__n"))

    missing = staged(copies.join(known(), "content", "left_anti").select("content"), "missing")
    n_missing = missing.count()
    # copies meet on the map side first, so a third of all rows with one text are a row a task after that
    texts, first = rows.select(content.alias("content"), "__text"), F.first("__text").alias("__text")
    if n_missing <= SENT:
        misses = texts.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(first)
    else:
        misses = texts.groupBy("content").agg(first).join(missing, "content", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer)
        for batch in batches:
            found = np.fromiter((of(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            named = pa.array([version] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), named], names=["content", "n_tokens", "tokenizer"])

    if n_missing:
        misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return salted_join(keyed, known(), ["content"], hot_keys(copies), ["__id"]).select(
        F.col("__id").alias(id_col), "n_bytes", F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, over a cache that begins empty."""
    return token_counts(table(spark, sf_dir, "documents"), fresh_path(spark, "counts"), tokenizer_path("word_bpe_49k.json"))
