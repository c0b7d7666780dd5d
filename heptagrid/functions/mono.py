"""The number line of a level: a cell's base and digits as one number to base 7.

Sorting, ranges, joins and files go by this number: the descendants of a cell are an interval, siblings differ by one, and
it is never negative. The level is a Python int, so expressions are unrolled when the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import base_cell, digit, pack

#: By base cell, the digit that never comes first after zeros, as the pentagon lacks that direction.
EXCLUDED = (2, 2, 2, 2, 2, 2, 5, 5, 5, 5, 5, 5)


def to_mono(cell: Column, level: int) -> Column:
    number = base_cell(cell).cast("long")
    for i in range(1, level + 1):
        number = number * 7 + digit(cell, i)
    return number


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by).cast("long"))


def from_mono(number: Column, level: int) -> Column:
    parts = [F.pmod(_div(number, 7 ** (level - i)), F.lit(7)) for i in range(1, level + 1)]
    return pack(_div(number, 7**level), parts)


def parent_mono(number: Column, levels: int = 1) -> Column:
    """The ancestor's number, so many levels up: the key by which to partition."""
    return _div(number, 7**levels)


def interval(number: Column, levels: int) -> tuple[Column, Column]:
    """First and last number of the descendants, so many levels down."""
    return number * 7**levels, number * 7**levels + (7**levels - 1)


def within(number: Column, ancestor: int, levels: int) -> Column:
    """Whether a number is a descendant of an ancestor's, as a range that Parquet statistics can prune by."""
    return number.between(ancestor * 7**levels, (ancestor + 1) * 7**levels - 1)


def is_slot(number: Column, level: int) -> Column:
    """Whether a number is on the line, be it a cell's or not."""
    return (number >= 0) & (number < 12 * 7**level)


def leads_well(number: Column, level: int) -> Column:
    """Whether a number's first digit that isn't 0 is not the one that its base cell excludes; past the line's end, as on the
    base cells before it."""
    first = F.lit(-1)
    for i in range(level, 0, -1):
        d = F.pmod(_div(number, 7 ** (level - i)), F.lit(7))
        first = F.when(d != 0, d.cast("int")).otherwise(first)
    return first != F.when(_div(number, 7**level) < 6, F.lit(EXCLUDED[0])).otherwise(F.lit(EXCLUDED[6]))


def is_valid(number: Column, level: int) -> Column:
    """Whether a number is a cell's: it is on the line, and its first digit that isn't 0 is not the one that its base cell excludes."""
    return is_slot(number, level) & leads_well(number, level)


def descendants(df: DataFrame, number: str, levels: int, out: str = "child") -> DataFrame:
    """A row per slot below each row's; at what level the slots are cells, :func:`is_valid` tells."""
    low, high = interval(F.col(number), levels)
    return df.withColumn(out, F.explode(F.sequence(low, high)))


def slots(level: int) -> dict[str, int]:
    """How many slots, cells and holes the line of a level has."""
    total, cells = 12 * 7**level, 10 * 7**level + 2
    return {"slots": total, "cells": cells, "holes": total - cells}


def all_cells(spark, level: int) -> DataFrame:
    """mono, cell of the whole earth at a level."""
    line = spark.range(12 * 7**level).withColumnRenamed("id", "mono").where(is_valid(F.col("mono"), level))
    return line.withColumn("cell", from_mono(F.col("mono"), level))


def random_cells(spark, level: int, n: int, seed: int = 0) -> DataFrame:
    """Up to n cells, drawn by hashes; slots that are no cells fall out."""
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(12 * 7**level))
    line = spark.range(n).select(drawn.alias("mono")).distinct().where(is_valid(F.col("mono"), level))
    return line.withColumn("cell", from_mono(F.col("mono"), level))
