"""Connected components: links are joined within tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hot_keys, salted_join, staged

#: Links that a task joins at once.
ROOM = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these links but the smallest of its component, ascending, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least, before = np.arange(len(nodes)), None
    while before is None or (least != before).any():
        before, least = least, least.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        while (least[least] != least).any():
            least = least[least]
    joined = least < np.arange(len(nodes))
    return nodes[joined], nodes[least[joined]]


def _contracted(edges: DataFrame) -> DataFrame:
    """u > v: links that join the same nodes, in each task the stars of ROOM links at a time. Where files are few and small, a
    task reads many of them; so what is left of small components meets in few tasks, without an exchange."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= ROOM:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.mapInArrow(contract, "u bigint, v bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, or larger ones alone."""
    ends = edges.select("u", "v").union(edges.select("v", F.lit(None).cast("long")))
    node = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.bool_or(F.col("v").isNull()).alias("above"))
    return node.where("least < most OR least IS NOT NULL AND above").count() == 0


def components(links: DataFrame) -> DataFrame:
    """links: a, b (bigint). Returns node, label (the smallest node that it reaches) for every node of a link.

    Tasks first join the links they read, and again as long as the next reading takes half as many tasks. What isn't stars by
    then goes through rounds: minima are combined on the map side and joined back, so a node with very many links is never held as
    a list, and its links are dealt to many tasks. Each round is written to the shared folder; rounds grow with the logarithm
    of the nodes. Repeated links and links of a node with itself count for nothing; without others the result is empty.
    """
    edges, last = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        parts, before = edges.rdd.getNumPartitions(), None
        while before is None or 1 < parts <= before // 2:
            edges = staged(_contracted(edges), "stars")
            if last is not None:
                dropped(last)
            last, before, parts = edges, parts, edges.rdd.getNumPartitions()
        if _are_stars(edges):
            break
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        hot = hot_keys(both.groupBy("u").agg(F.count("*").alias("n")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], hot, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, least, ["u"], hot, ["v"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).where("u <> v").distinct()
        edges = staged(small, "stars")
        dropped(last)
        last = edges
    found = staged(edges.toDF("node", "label").union(edges.select("v", "v")).distinct(), "labels")
    dropped(edges)
    return found
