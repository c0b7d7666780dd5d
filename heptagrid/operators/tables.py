"""Small operations on tables of cells: missing values, nearest centroids, fixed orders, groups, gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec


def missing(value: Column, nodata: float) -> Column:
    """Null where a raster has its value for no data; NaN for no data stands for itself."""
    gone = F.isnan(value) if math.isnan(nodata) else value == nodata
    return F.when(~F.coalesce(gone, F.lit(True)), value)


def nearest(centroids: DataFrame, lon: float, lat: float) -> DataFrame:
    """The one row of centroids (lon, lat and more) nearest to a point on the sphere, of equals the least; none of an empty table.

    A row a task is kept on the map side.
    """
    x, y = F.radians("lon"), F.radians("lat")
    a, b = math.radians(lon), math.radians(lat)
    near = F.sin((y - b) / 2) ** 2 + F.cos(y) * math.cos(b) * F.sin((x - a) / 2) ** 2
    row = F.struct(*[F.col(f"`{c}`") for c in centroids.columns])
    best = centroids.where("lon IS NOT NULL AND lat IS NOT NULL").agg(F.min(F.struct(near.alias("d"), row.alias("row"))).alias("best"))
    return best.where("best IS NOT NULL").select("best.row.*")


def reindex(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """A row per row of order (its key and place) with df's values, null where df has none; df has a key once."""
    return order.join(df, key, "left")


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, n: pairs that differ. A null is a value like any other."""
    return df.groupBy(a, b).agg(F.lit(1).alias("one")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact median of what is known by key."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, std (of a sample), min, q25, q50, q75 (by linear interpolation), max of what is known."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    quarters = [F.percentile(x, q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *quarters, F.max(x).alias("max"))


def listed(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values by key as an ascending list. A key's values are held together, so for keys of bounded size, as children of a cell."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def id_gaps(df: DataFrame, mono: str = "mono", cell: str = "cell", bucket: int = 7**5) -> DataFrame:
    """cell, gap: how far each raw id is from the one before it on the line, null for the first and for base cells from 8 on
    after others, whose difference is no signed long; windows go over buckets, and over the buckets' ends alone."""
    part = F.call_function("div", F.col(mono), F.lit(bucket).cast("long"))
    rows = df.select(F.col(mono).alias("mono"), F.col(cell).alias("cell"), part.alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.max_by("cell", "mono").alias("last"))
    before = ends.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("before"))
    inside = rows.withColumn("prev", F.lag("cell").over(Window.partitionBy("bucket").orderBy("mono")))
    gap = F.try_subtract(F.col("cell"), F.coalesce("prev", "before"))
    return inside.join(before, "bucket").select("cell", gap.alias("gap"))


def with_parent(df: DataFrame, summary: DataFrame, level: int, cell: str = "cell", parent: str = "parent") -> DataFrame:
    """df with the columns of the summary of each cell's ancestor, null where it has none; the summary has a parent once."""
    found = summary.withColumnRenamed(parent, "__parent")
    return df.withColumn("__parent", codec.parent_at(F.col(cell), level)).join(found, "__parent", "left").drop("__parent")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other: none if they are equal as bags of rows."""
    return a.exceptAll(b).union(b.exceptAll(a))
