"""Archives of cells and variables: Parquet sorted along the number line, a range table, and a row of metadata as JSON.

    path/cells    mono, variables (and cell, if compression is none or dense ids are asked for), in ranges of mono
    path/ranges   start, end, n, offset (compression ranges)
    path/dggs     the metadata, in its block coordinate the attributes of the ids

All three are written and read by Spark, so a path may be in any store that it knows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, mono
from ..operators import ranges as R
from ..staging import staged

COMPRESSIONS = ("none", "ranges")
ELLIPSOID = {"name": "wgs84", "semimajor_axis": 6378137.0, "inverse_flattening": 298.257223563}
#: The longitude of the grid's first vertex, and by which level digits turn which way.
VERTEX_LON = 11.2
ROTATION = "alternating_cw_odd_ccw_even"
SINKS = ("parquet", "csv", "json")


def metadata(level: int, compression: str, vert0_lon: float = VERTEX_LON, vert0_lat: float = 58.28252559, vert0_azimuth: float = 0.0, extra: dict | None = None) -> dict:
    return {
        "name": "igeo7", "refinement_level": level, "spatial_dimension": "cells", "coordinate": "cell_ids", "compression": compression,
        "ellipsoid": ELLIPSOID, "dggs_vert0_lon": vert0_lon, "dggs_vert0_lat": vert0_lat, "dggs_vert0_azimuth": vert0_azimuth,
        "rotation_pattern": ROTATION, "cell_ids": coordinate_attributes(level, vert0_lon),
    } | (extra or {})


def coordinate_attributes(level: int, vert0_lon: float = VERTEX_LON) -> dict:
    return {"grid_name": "igeo7", "level": level, "igeo7_dggs_vert0_lon": vert0_lon, "igeo7_wgs84_geodetic_conversion": True}


def write_archive(
    df: DataFrame, path: str, level: int, variables: list[str], compression: str = "none", dense_ids: bool = False, cell: str = "cell", slots: bool = False, **attrs
) -> None:
    """Refuses an existing path, an unknown compression, a null or repeated id, and an id that is not of the level. Slots of the
    line that are no cells are refused too, unless ``slots`` asks for them."""
    if compression not in COMPRESSIONS:
        raise ValueError(f"no compression {compression}")
    spark, id_ = df.sparkSession, F.col(cell)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileExistsError(path)
    # written once, as what follows reads it many times; checks of numbers made in place took several times as long
    rows = staged(df.select(mono.to_mono(id_, level).alias("mono"), id_.alias("cell"), *variables), "rows")
    number, id_ = F.col("mono"), F.col("cell")
    fits = id_.isNotNull() & (codec.resolution(id_) == level) & (mono.is_slot(number, level) if slots else mono.is_valid(number, level))
    bad = rows.where(~F.coalesce(fits, F.lit(False))).limit(1).count()
    if bad or rows.groupBy("mono").count().where("count > 1").limit(1).count():
        raise ValueError("an id is null, repeated, or not a cell of the level")
    kept = rows if compression == "none" or dense_ids else rows.drop("cell")
    kept.repartitionByRange("mono").sortWithinPartitions("mono").write.option("compression", "zstd").parquet(f"{path}/cells")
    if compression == "ranges":
        R.range_offsets(R.find_ranges(rows)).coalesce(1).write.parquet(f"{path}/ranges")
    meta = json.dumps(metadata(level, compression, **attrs))
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/dggs")


def append_variables(spark: SparkSession, path: str, out: str, df: DataFrame, variables: list[str], cell: str = "cell") -> None:
    """The archive at a path, written to another with df's variables by cell; null where df lacks a cell, and those of the same
    name replaced. df's cells are not repeated. The ids are those of the archive, so slots that it took are taken again."""
    meta = read_metadata(spark, path)
    before = open_archive(spark, path)
    kept = [c for c in before.columns if c not in ("mono", *variables)]
    rows = before.select(*kept).join(df.select(F.col(cell).alias("cell"), *variables), "cell", "left")
    dense = "cell" in spark.read.parquet(f"{path}/cells").columns
    names = [c for c in kept if c != "cell"]
    write_archive(rows, out, meta["refinement_level"], [*names, *variables], meta["compression"], dense, slots=True)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table of results, or a lookup table, as a folder of files of a kind; refuses a path that is there."""
    if kind not in SINKS:
        raise ValueError(f"no sink {kind}")
    df.write.format(kind).mode("error").options(**({"header": True} if kind == "csv" else {})).save(path)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).options(**({"header": True} if kind == "csv" else {})).schema(schema).load(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Defaults where an older archive says nothing."""
    found = json.loads(spark.read.text(f"{path}/dggs", wholetext=True).first()[0])
    found = metadata(found.get("refinement_level"), found.get("compression", "none")) | found
    if found["compression"] not in COMPRESSIONS:
        raise ValueError(f"no compression {found['compression']}")
    return found


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    """cell, mono and the variables; ids that were not kept are made from mono, in the scan. Lazy."""
    meta = read_metadata(spark, path)
    df = spark.read.parquet(f"{path}/cells")
    if "cell" not in df.columns:
        df = df.withColumn("cell", mono.from_mono(F.col("mono"), meta["refinement_level"]))
    return df.select("cell", "mono", *[c for c in df.columns if c not in ("cell", "mono")])


def open_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ranges")


def read_zone(df: DataFrame, ancestor: int, levels: int) -> DataFrame:
    """Rows below an ancestor, by its number and how many levels it is up; the bounds reach the scan."""
    return df.where(mono.within(F.col("mono"), ancestor, levels))


def select_cells(df: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of the cells given, each once however often it is asked for; strict: an error if any is missing."""
    if strict and cells.join(df, "mono", "left_anti").limit(1).count():
        raise KeyError("a cell is not in the archive")
    return df.join(cells.select("mono").distinct(), "mono", "left_semi")


def read_uint64(spark: SparkSession, path: str, column: str = "z7int") -> DataFrame:
    """A Parquet file with unsigned 64-bit ids: the column as a long with the same bits, called cell."""
    df = spark.read.parquet(path)
    return df.withColumn(column, codec.from_uint64(F.col(column))).withColumnRenamed(column, "cell")
