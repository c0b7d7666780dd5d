"""The corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, best-fit packing.

Every stage works on all rows that the one before kept, whole texts and all columns. A null or empty text is rejected by the
quality rules. Repeated rows are each judged; of a group of near copies those with the smallest id stay, and every row of one
without any id. An empty table gives an empty result. Columns beside those of documents ride along to the last stage, which
returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heptagrid.llm.common import staged, table, tokenizer_path
from heptagrid.llm.jaccard_join import one_of_each
from heptagrid.llm.packing import pack
from heptagrid.llm.quality_classifier import keep_predicted, train
from heptagrid.llm.quality_rules import keep_quality


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of those given, predicts to be good."""
    return keep_predicted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest id. Sets are of five words, and link from 0.8 on."""
    return one_of_each(docs, percent=80, words=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("jaccard_join", near_duplicates),
    ("packing", packing),
]
#: A trained classifier can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each over what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
