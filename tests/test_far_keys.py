"""Queries against their SQL where keys go on to slots that are no cells, to pentagons, and past the line's end."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heptagrid.functions import mono
from heptagrid.operators import focal, neighbours, zonal
from heptagrid.plans.oracle import ORACLES
from heptagrid.plans.queries import AOI_START, QUERIES
from heptagrid.sources import archive

from .test_queries import rows

#: Around the first slot of the area that is no cell.
EDGE = 117649


def write(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def events(ids):
    kinds = ["view", "click", "view", "view", "error", "click"]
    return {"event_id": pa.array(ids, pa.int64()), "event_type": [kinds[k % 6] for k in ids], "value": [k * 37 % 1009 / 2 for k in ids]}


def agree(spark, d, name):
    con = duckdb.connect()
    for file in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, d)
    got, cur = rows(df.columns, map(tuple, df.collect())), con.execute(ORACLES[name])
    assert got and got == rows([x[0] for x in cur.description], cur.fetchall())
    return got


@pytest.mark.parametrize("name", ["archive_round_trip", "archive_dense", "archive_append", "archive_metadata"])
def test_archives_of_slots(spark, tmp_path, name):
    agree(spark, write(tmp_path, events=events(range(EDGE - 40, EDGE + 40))), name)


def test_archive_refuses_slots_unless_asked(spark, tmp_path):
    df = spark.range(AOI_START + EDGE - 3, AOI_START + EDGE + 3).select(mono.from_mono(F.col("id"), 7).alias("cell"), "id")
    with pytest.raises(ValueError):
        archive.write_archive(df, str(tmp_path / "x"), 7, ["id"], "ranges")
    with pytest.raises(ValueError):
        archive.write_archive(df.select(mono.from_mono(F.col("id") + 12 * 7**7, 7).alias("cell"), "id"), str(tmp_path / "y"), 7, ["id"], slots=True)
    archive.write_archive(df, str(tmp_path / "z"), 7, ["id"], "ranges", slots=True)
    assert archive.open_archive(spark, str(tmp_path / "z")).exceptAll(df.select("cell", F.col("id").alias("mono"), "id")).count() == 0


def lopsided(spark):
    """Events at slots that are no cells, and at all their neighbours, of which some are in other blocks and don't have them for one."""
    asked = spark.createDataFrame([(AOI_START + k,) for k in (137285, 137287, 137289, 137355)], "m long").select(mono.from_mono(F.col("m"), 7).alias("cell"))
    found = neighbours.k_ring(asked, 1).select(mono.to_mono(F.col("cell"), 7)).collect()
    ids = sorted(r[0] - AOI_START for r in found)
    return events(ids) | {"event_type": ["view"] * len(ids)}


def test_gather_of_slots_is_the_join(spark):
    line = spark.range(12 * 7**3).withColumnRenamed("id", "mono")
    for level, df in ((3, line), (7, line.withColumn("mono", F.col("mono") + AOI_START + 137000))):
        df = df.select(mono.from_mono(F.col("mono"), level).alias("cell"), (F.col("mono") % 31).cast("double").alias("value"), "mono")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(focal, "BLOCK_LEVELS", 1)
            names = ["cell", "mono", "value", *focal.RING, "n_nbrs"]
            got = {r.cell: tuple(r) for r in focal.gather(df, level).select(names).collect()}
        want = focal.gather_by_join(df).select(names).collect()
        assert len(want) == 12 * 7**3 and got == {r.cell: tuple(r) for r in want}


def test_slots_that_are_no_cells(spark):
    rows = spark.range(12 * 7**3).select(mono.from_mono(F.col("id"), 3).alias("cell"), mono.is_valid(F.col("id"), 3).alias("valid")).collect()
    assert neighbours.no_cells(np.array([r.cell for r in rows])).tolist() == [not r.valid for r in rows]


@pytest.mark.parametrize("name", ["slope_isotropic", "slope_lookup", "slope_degrees_stats", "slope_geodesic", "slope_variants", "relative_errors"])
def test_slopes_of_slots(spark, tmp_path, name):
    agree(spark, write(tmp_path, events=lopsided(spark)), name)


def test_children_past_the_end_of_the_line(spark, tmp_path):
    """No base cell is there, so what is left out is by the rule of the last ones."""
    got = agree(spark, write(tmp_path, part={"p_partkey": [0, 1, 28811, 28812, 28813, 120000]}), "children")
    assert len(got) > 6 * 6 and max(r[1] for r in got) >= 28812


def test_descendants_past_the_end_of_the_line(spark, tmp_path):
    got = agree(spark, write(tmp_path, supplier={"s_suppkey": [0, 4115, 4116, 4117, 6000]}), "descendants_k")
    assert len(got) == 5


def around(spark, cell):
    """Events at a cell and its neighbours."""
    found = neighbours.k_ring(spark.createDataFrame([(cell,)], "cell long"), 1).select(mono.to_mono(F.col("cell"), 7)).collect()
    ids = sorted(r[0] - AOI_START for r in found)
    return events(ids) | {"event_type": ["view"] * len(ids)}


def test_bearing_due_south(spark, tmp_path):
    got = agree(spark, write(tmp_path, events=around(spark, 1461815552535166975)), "direction_geodesics")
    assert any(180.0 in r for r in got) and not any(-180.0 in r for r in got)


PENTAGON = 2305843558969507839


def test_sweep_of_a_pentagon(spark, tmp_path):
    got = agree(spark, write(tmp_path, events=around(spark, PENTAGON)), "axis_sweep")
    assert any(PENTAGON in r for r in got)


@pytest.mark.parametrize("name", ["axis_sweep_by_parent", "lookup_table_sink"])
def test_sweep_by_parent_of_a_pentagon(spark, tmp_path, name):
    agree(spark, write(tmp_path, events=around(spark, PENTAGON)), name)


def test_histogram_of_edges(spark, tmp_path):
    """Values on all edges, below, above, and missing."""
    values = [k * 10.0 for k in range(51)] + [-0.5, 500.5, 560.21, None]
    table = events(range(len(values))) | {"value": values}
    agree(spark, write(tmp_path, events=table), "histogram")
    df = spark.createDataFrame([(290.0,)], "x double")
    assert zonal.histogram(df, "x", 0.0, 500.0, 50).first().bin == 30 and zonal.histogram(df, "x", 0.0, 500.0, 50, by_share=True).first().bin == 29
