"""Codec, number line, latitudes, neighbours, ranges, focal operators and archives: hand-computed values and properties."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heptagrid.functions import codec, geodesy, latitudes, mono, stats
from heptagrid.operators import focal, neighbours, ranges, zonal
from heptagrid.sources import archive


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x)


def cell(text):
    return codec.from_string(F.lit(text))


def test_stats(spark):
    assert [stats.num_cells(r) for r in (0, 6, 10, 20)] == [12, 1176492, 2824752492, 797922662976120012]
    assert stats.cell_area_m2(0) == 51006562172408.9 and stats.cell_area_m2(14) == 75.2 and stats.cls_m(9) == 1268.6064
    for bad in (21, -1):
        with pytest.raises(ValueError):
            stats.resolution_stats(bad)
    f = stats.find_resolution
    r = one(
        spark, a=f(lit(1000.0), "cls_m"), b=f(lit(10**6), "num_cells", "larger"), c=f(lit(10**6), "num_cells", "smaller"), d=f(lit(10**6), "num_cells"),
        e=f(lit(100.0), "area_m2"), g=f(lit(500.0), "cls_m", "larger"), h=f(lit(5), "num_cells", "smaller"),
    )
    assert tuple(r) == (9, 6, 5, 6, 14, 9, None)
    with pytest.raises(ValueError):
        f(lit(1.0), "x")
    assert stats.stats_table(spark).count() == 21
    assert one(spark, a=stats.stat(lit(9), "cls_km"), b=stats.clipper_scale_factor(lit(9))) == (1.2686064, 10**7)


def test_codec(spark):
    h = codec.from_hex(lit("004291D4C313FFFF"))
    r = one(
        spark, id=h, base=codec.base_cell(h), s=codec.to_string(h), res=codec.resolution(h), hx=codec.to_hex(h), hres=codec.hex_resolution(lit("004291d4c313ffff")),
        pos=codec.hex_local_pos(lit("004291d4c313ffff")), up=codec.to_string(codec.parent(h)), ten=codec.to_string(codec.parent(h, 10)),
        same=codec.parent(h, 18) == h, dec=codec.decode(h), enc=codec.encode(lit(0), F.array(*map(lit, (1, 2, 3)))),
    )
    assert (r.id, r.base, r.s, r.res, r.hx, r.hres) == (18737691454865407, 0, "0001024435230304", 14, "004291d4c313ffff", 14)
    assert tuple(r.pos) == ("000102443523030", "4", False) and r.up == "000102443523030" and r.ten == "000102443523" and r.same
    assert list(r.dec.digits) == [0, 1, 0, 2, 4, 4, 3, 5, 2, 3, 0, 3, 0, 4] + [7] * 6
    for text in ("0800433", "1111", "091201", "05"):
        assert one(spark, s=codec.to_string(cell(text)), h=codec.to_string(codec.from_hex(codec.to_hex(cell(text))))) == (text, text)
    assert one(spark, a=cell("0800433")).a < 0
    got = one(spark, **{f"x{k}": codec.first_non_zero(cell(t)) for k, t in enumerate(("0000000", "1000000", "1234000", "1200567", "12"))})
    assert tuple(got) == (6, 6, 1, 3, 0)
    assert one(spark, a=codec.parent(cell("05")) == cell("05"), b=codec.base7_to_int(lit("100")), c=codec.int_to_base7(lit(49), 5)) == (True, 49, "00100")


def test_uint64_parquet(spark, tmp_path):
    pq.write_table(pa.table({"z7int": pa.array([5, (1 << 63) + 7, (1 << 64) - 1], pa.uint64())}), tmp_path / "u.parquet")
    assert sorted(r.cell for r in archive.read_uint64(spark, str(tmp_path / "u.parquet")).collect()) == [7 - (1 << 63), -1, 5]


@pytest.mark.parametrize("level", [0, 1, 2, 3, 4])
def test_line_and_neighbours_of_the_whole_earth(spark, level):
    cells = mono.all_cells(spark, level)
    rows = cells.withColumn("back", mono.to_mono(F.col("cell"), level)).withColumn("res", codec.resolution(F.col("cell"))).collect()
    assert len(rows) == stats.num_cells(level) and all(r.back == r.mono and r.res == level for r in rows)
    ids = np.array([r.cell for r in rows])
    out, exist = neighbours.ring(ids)
    assert sorted(set(exist.sum(1).tolist())) == ([5] if level == 0 else [5, 6]) and (exist.sum(1) == 5).sum() == 12
    known = set(ids.tolist())
    around = {c: set(out[k][exist[k]].tolist()) for k, c in enumerate(ids.tolist())}
    assert all(len(around[c]) == exist[k].sum() and around[c] <= known and c not in around[c] for k, c in enumerate(ids.tolist()))
    assert all(c in around[x] for c in around for x in around[c])


def test_line(spark):
    r = one(spark, a=mono.to_mono(cell("051"), 1) - mono.to_mono(cell("050"), 1), b=codec.to_string(mono.from_mono(mono.to_mono(cell("05012340123401"), 12), 12)), c=mono.to_mono(cell("00"), 0))
    assert tuple(r) == (1, "05012340123401", 0)
    assert [mono.slots(k)["holes"] for k in (1, 2, 4)] == [12, 96, 4800]
    kids = mono.descendants(spark.range(8, 9), "id", 2).select(mono.parent_mono(F.col("child"), 2).alias("p")).distinct().collect()
    assert [k.p for k in kids] == [8]
    assert mono.random_cells(spark, 6, 100).count() > 50


RINGS = {
    "0000": "0004 0006 0003 0001 0005", "0100": "0104 0106 0103 0101 0105", "0103": "0106 0161 0136 0134 0101 0100",
    "0136": "0161 0163 0132 0130 0134 0103", "0132": "0163 0055 0051 0133 0130 0136", "000": "001 003 004 005 006",
}


def test_rings(spark):
    df = spark.createDataFrame([(t,) for t in RINGS], "s string").withColumn("cell", codec.from_string(F.col("s")))
    got = neighbours.edges(df).where("nbr IS NOT NULL").select("s", codec.to_string(F.col("nbr")).alias("n")).groupBy("s").agg(F.collect_set("n").alias("n"))
    assert {r.s: set(r.n) for r in got.collect()} == {s: set(n.split()) for s, n in RINGS.items()}
    by_dir = [codec.to_string(F.get(neighbours.neighbours(F.col("cell")), F.lit(k))) for k in range(6)]
    rows = {r[0]: list(r)[1:] for r in df.select("s", *by_dir).collect()}
    assert rows["0103"] == "0134 0161 0136 0100 0101 0106".split() and rows["0132"] == "0133 0055 0051 0136 0130 0163".split()
    assert rows["000"][1] is None
    step = lambda t, d: one(spark, a=codec.to_string(neighbours.neighbour(cell(t), d, 2)["cell"]), b=neighbours.neighbour(cell(t), d, 2)["carry"])
    assert step("0103", 3) == ("0136", 0) and step("0103", 5) == ("0101", 0) and step("0166", 6).b == 6
    assert [neighbours.add(a, b, True) for a, b in ((0, 0), (0, 1), (1, 1), (1, 2))] == [(0, 0), (0, 1), (1, 4), (0, 3)]
    assert [neighbours.add(a, b, False) for a, b in ((0, 0), (0, 1), (1, 1), (1, 2), (6, 1))] == [(0, 0), (0, 1), (1, 2), (0, 3), (0, 0)]
    base = [[neighbours.base_cell_neighbour(b, k) for k in range(5)] for b in (0, 1, 5, 6, 11)]
    assert base == [[5, 4, 2, 1, 3], [5, 0, 6, 10, 2], [4, 0, 10, 9, 1], [10, 2, 1, 11, 7], [9, 6, 10, 8, 7]]
    assert neighbours.base_cell_neighbour(1, 5) is None and neighbours.base_cell_neighbours_table(spark).count() == 60
    assert neighbours.k_ring(df.where("s = '0136'"), 1).count() == 7
    assert spark.createDataFrame([(None,)], "cell long").select(neighbours.neighbours(F.col("cell"))).first()[0] is None


def test_tables_have_their_structure():
    for carry in (neighbours.CARRY_CW, neighbours.CARRY_CCW):
        t = np.array(carry)
        assert (t == t.T).all() and (t[0] == 0).all() and (np.diag(t) == np.arange(7)).all()
    around = [set(x) for x in neighbours.BASE_NEIGHBOURS]
    assert all(a in around[b] for a in range(12) for b in around[a])


def test_latitudes(spark):
    there, back = latitudes.geodetic_to_authalic, latitudes.authalic_to_geodetic
    for x in (0.0, 90.0, -90.0, 80.0, -80.0, 45.0, -45.0, 10.0):
        r = one(spark, a=there(lit(x)), b=back(there(lit(x))), c=there(F.radians(lit(x)), degrees=False))
        assert abs(r.b - x) < 1e-11 and abs(math.degrees(r.c) - r.a) < 1e-11
        assert abs(r.a - x) < 1e-12 if abs(x) in (0, 90) else abs(r.a) < abs(x)
    assert abs(latitudes.arc_unit() - 0.998324298) < 1e-8 and latitudes.third_flattening(0) == 0


def test_geodesy(spark):
    r = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (24.0, 58.0, 24.0, 58.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [tuple(x.g) if x.g else None for x in r.select(geodesy.geodesic_struct(*map(F.col, "abcd")).alias("g")).collect()]
    assert abs(got[0][0] - 110574.3886) < 0.01 and abs(got[1][0] - 111319.4908) < 0.01 and got[1][1] == 90 and got[2][0] == 0 and got[3] is None
    turns = spark.createDataFrame([(350.0,), (10.0,)], "x double").agg(*geodesy.circular_mean_std(F.col("x"))).first()
    assert min(turns[0], 360 - turns[0]) < 1e-9 and abs(turns[1] - 10) < 0.2
    assert one(spark, a=geodesy.angle_difference(lit(350.0), lit(10.0))).a == -20


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BUCKET", 7)
    numbers = [1, 2, 3, 4, 9, 10, 11, 21, 22, 40] + list(range(50, 120))
    df = spark.createDataFrame([(x,) for x in numbers], "mono long")
    found = ranges.find_ranges(df)
    assert sorted(map(tuple, found.collect())) == [(1, 4), (9, 11), (21, 22), (40, 40), (50, 119)]
    assert sorted(r.mono for r in ranges.expand_ranges(found).collect()) == numbers
    offsets = ranges.range_offsets(found)
    asked = spark.createDataFrame([(x,) for x in (0, 1, 10, 23, 40, 119, 120)], "mono long")
    assert {r.mono: r.position for r in ranges.positions(asked, offsets).collect()} == {0: -1, 1: 0, 10: 5, 23: -1, 40: 9, 119: 79, 120: -1}
    assert sorted(r.mono for r in ranges.slice_cells(offsets, 3, 10).collect()) == numbers[3:10]
    assert ranges.find_ranges(df.limit(0)).count() == 0
    twice = ranges.find_ranges(df.union(df.limit(1)))
    assert twice.count() == 6
    place = {r[0]: r[1] for r in spark.range(10).select("id", ranges.round_robin_position(F.col("id"), 10, 3)).collect()}
    assert sorted(place.values()) == list(range(10)) and [place[k] for k in (0, 3, 6, 9)] == [0, 1, 2, 3]


def plane(spark, level=7, n=2000):
    """Cells of one subtree with heights on a plane, by laying rings out on the hexagonal axes."""
    return spark.range(941192, 941192 + n).select(F.col("id").alias("mono"), mono.from_mono(F.col("id"), level).alias("cell"), (F.col("id") % 97).cast("double").alias("value"))


def test_slope_against_a_loop_and_partitions(spark):
    df = plane(spark)
    got = {r.cell: r.slope for r in focal.slope(df, 7, mode="isotropic").collect()}
    assert got == {r.cell: r.slope for r in focal.slope(df.repartition(13), 7, mode="isotropic").collect()}
    h = {r.cell: r.value for r in df.collect()}
    cells = np.array(list(h))
    out, exist = neighbours.ring(cells)
    d = stats.cls_m(7) * stats.CENTROID_FACTOR
    finite = 0
    for k, c in enumerate(cells.tolist()):
        v = [h.get(x) if e else None for x, e in zip(out[k].tolist(), exist[k])]
        if None in v:
            assert got[c] is None
            continue
        want = math.hypot((v[0] - v[5]) / (2 * d), (v[3] + v[4] - v[1] - v[2]) / (2 * math.sqrt(3) * d))
        assert abs(got[c] - want) < 1e-12
        finite += 1
    assert finite > 1500
    odd = F.when(F.col("mono") == 941300, F.lit(float("nan"))).when(F.col("mono") != 941400, F.col("value"))
    missing = {r.mono: r.slope for r in focal.slope(df.withColumn("value", odd), 7, mode="isotropic").collect()}
    assert math.isnan(missing[941300]) and missing[941400] is None
    assert sum(v is None for v in missing.values()) >= 2000 - finite + 6
    for bad in ({"mode": "lookup"}, {"mode": "geodesic"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            focal.slope(df, 7, **bad)
    acc = neighbours.boundary_accounting(df).first()
    assert acc.cells == 2000 and acc.pentagon == 0 and acc.out_of_area == acc.boundary_only == 2000 - finite


@pytest.mark.parametrize("level", [2, 7])
def test_gather_is_the_join(spark, level, monkeypatch):
    monkeypatch.setattr(focal, "BLOCK_LEVELS", 2)
    df = mono.all_cells(spark, 2) if level == 2 else plane(spark, n=3000).where("mono % 19 <> 4")
    df = df.withColumn("value", F.when(F.col("mono") % 23 != 0, (F.col("mono") % 31).cast("float"))).withColumn("other", F.col("mono").cast("string"))
    names = ["cell", "other", "value", *focal.RING, "n_nbrs"]
    a, b = focal.gather(df, level).select(names), focal.gather_by_join(df.where("value IS NOT NULL")).select(names)
    got = {r.cell: tuple(r) for r in a.collect()}
    assert len(got) == df.count()
    assert {c: r for c, r in got.items() if r[2] is not None} == {r.cell: tuple(r) for r in b.collect()}
    assert focal.gather(df.limit(0), level).count() == 0


def test_dominance_and_metrics(spark):
    rows = [(6.1, 0.4, 6.3, 0.5, 6.0, 0.6), (2.2, 0.3, 2.1, 0.4, 2.3, 0.3), (12.0, 1.3, 5.0, 0.9, 5.5, 0.6), (1.5, 0.02, 7.0, 0.1, 7.0, 0.1)]
    df = spark.createDataFrame(rows, "mean_d_i double, std_d_i double, mean_d_j double, std_d_j double, mean_d_k double, std_d_k double")
    assert [r.axis for r in focal.dominant_axis(df).collect()] == [None, None, "i", "j"]
    assert [r.axis for r in focal.dominant_axis(df, use_std=True, std_mult=5.0).collect()] == [None] * 4
    assert [(r.axis, r.side) for r in focal.dominant_axis_twosided(df).collect()] == [(None, None), (None, None), ("i", "high"), ("i", "low")]
    m = focal.axis_metrics(spark.createDataFrame([(1.0, 1.0, 8.0)], "d_k double, d_j double, d_i double")).first()
    assert m.squeezed_axis == "k" and abs(m.d_geom_mean - 2) < 1e-12 and m.squeeze_ratio == 0.125
    fit = focal.plane_fit(spark.createDataFrame([(1, x, y, 3 * x - 4 * y) for x, y in ((1.0, 0.0), (0.0, 1.0), (2.0, 5.0))], "k int, east double, north double, dh double"), "k").first()
    assert abs(fit.a - 3) < 1e-9 and abs(fit.b + 4) < 1e-9 and abs(fit.slope - 5) < 1e-9


def test_geodesics_between_nearly_opposite_points():
    """Published distances and azimuths of geodesics for which iteration doesn't settle, and both solvers against each other."""
    r = np.radians
    inverse = lambda *p: geodesy.vincenty(*(r(np.array([x], float)) for x in p))
    for lon, lat, distance, azimuth in ((179.5, 0.5, 19936288.579, 25.671873), (179.7, 0.5, 19944127.421, 15.556883), (180, 0, 20003931.4586, None)):
        d, a = inverse(0, 0, lon, lat)
        assert abs(d[0] - distance) < 1e-3 and (azimuth is None or abs(a[0] - azimuth) < 1e-5)
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(-89, 89, (2, 3000)), rng.uniform(-180, 180, (2, 3000))
    d, a = geodesy.vincenty(r(lon[0]), r(lat[0]), r(lon[1]), r(lat[1]))
    reduced = [np.arctan((1 - geodesy.FLAT) * np.tan(r(y))) for y in lat]
    d2, a2 = geodesy.opposite(*reduced, r(lon[1] - lon[0]))
    assert np.abs(d - d2).max() < 1e-5 and np.abs((a - a2 + 180) % 360 - 180).max() < 1e-7
    x = rng.uniform(-1, 1, (3, 2000))
    there = geodesy.vincenty(*r([0 * x[0], x[0] * 80, 180 + x[1], x[2] - x[0] * 80]))[0]
    back = geodesy.vincenty(*r([180 + x[1], x[2] - x[0] * 80, 0 * x[0], x[0] * 80]))[0]
    assert np.isfinite(there).all() and np.abs(there - back).max() < 1e-5


def test_geodesic_slope_of_a_regular_grid_is_isotropic_slope(spark):
    """Where all centroids are as far apart as the level's, both modes agree; directions and sweep keep what is missing apart."""
    df = mono.all_cells(spark, 2).withColumn("value", (F.col("mono") % 31).cast("double"))
    places = df.select("cell", F.pmod("mono", F.lit(360)).cast("double").alias("lon"), (F.pmod(F.col("mono") * 7, F.lit(179)) - 89).cast("double").alias("lat"))
    far = {(r.cell, r.dir): (r.nbr, r.distance, r.bearing) for r in focal.directions(df, places.where("lon <> 7")).collect()}
    at = {r.cell: (r.lon, r.lat) for r in places.collect()}
    assert len(far) == 6 * df.count() - 12
    gone = {c for c, (x, _) in at.items() if x == 7}
    for (c, _), (n, d, b) in far.items():
        if c in gone or n in gone:
            assert d is None and b is None
        else:
            want, turn = geodesy.vincenty(*(np.radians(np.array([v])) for v in (*at[c], *at[n])))
            assert abs(d - want[0]) < 1e-3 and abs((b - turn[0] + 180) % 360 - 180) < 1e-6 and -180 <= b < 180
    slopes = {r.cell: r.slope for r in focal.slope(df, 2, mode="geodesic", centroids=places).collect()}
    h = {r.cell: r.value for r in df.collect()}
    ends = {}
    for (c, k), (n, d, _) in {(r.cell, r.dir): (r.nbr, r.distance, 0) for r in focal.directions(df, places).collect()}.items():
        ends.setdefault(c, {})[k] = (h[n], d)
    for c, e in ends.items():
        if len(e) < 6:
            assert slopes[c] is None
            continue
        dx = (e[1][0] - e[6][0]) / (e[1][1] + e[6][1])
        dy = (e[4][0] + e[5][0] - e[2][0] - e[3][0]) / (math.sqrt(3) * ((e[2][1] + e[5][1]) / 2 + (e[4][1] + e[3][1]) / 2))
        assert abs(slopes[c] - math.hypot(dx, dy)) < 1e-9
    assert focal.axis_sweep(df, places).count() == df.count() - 12


def test_pentagons(spark):
    for level in (0, 1, 3):
        rows = mono.all_cells(spark, level).withColumn("p", neighbours.is_pentagon(F.col("cell"))).withColumn("n", neighbours.neighbours(F.col("cell"))).collect()
        assert all(r.p == (None in r.n) for r in rows) and sum(r.p for r in rows) == 12
    assert one(spark, a=neighbours.is_pentagon(codec.from_string(lit("0001"))), b=neighbours.is_pentagon(lit(None).cast("long"))) == (False, None)


def test_clashing_columns_null_cells_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(focal, "BLOCK_LEVELS", 2)
    df = plane(spark, n=400)
    clash = {n: F.lit(-7.0) for n in ("h1", "n_nbrs", "w_k", "parent", "d_k", "start", "n", "offset", "__x", "dir")}
    odd = df.withColumns(clash).union(df.withColumns(clash).withColumn("cell", F.lit(None).cast("long"))).union(df.withColumns(clash).limit(3))
    model = focal.distortion_model(spark.createDataFrame([(1, 1.0, 2.0, 3.0, 2.0), (1, 1.0, 2.0, 3.0, 2.0)], "parent long, mean_d_k double, mean_d_j double, mean_d_i double, mean_d_geom double"))
    want = {r.cell: r.slope for r in focal.slope(df, 7, mode="isotropic").collect()}
    for mode in ("isotropic", "lookup"):
        got = focal.slope(odd, 7, model, mode)
        assert got.columns == [*odd.columns, "slope"] and got.count() == 803
        assert {r.cell: r.slope for r in got.where("cell IS NOT NULL").collect()} == want
        assert got.where("cell IS NULL AND slope IS NULL AND h1 = -7").count() == 400
    offsets = ranges.range_offsets(ranges.find_ranges(df))
    placed = ranges.positions(odd, offsets)
    assert placed.columns == [*odd.columns, "position"] and placed.agg(F.max("position"), F.min("n")).first() == (399, -7.0)
    assert neighbours.edges(odd.limit(1)).columns == [c for c in odd.columns if c != "dir"] + ["dir", "nbr"]
    assert neighbours.boundary_accounting(odd).first() == neighbours.boundary_accounting(df).first()
    assert neighbours.k_ring(odd, 2).count() == neighbours.k_ring(df, 2).count()
    assert sorted(r.mono for r in ranges.at_positions(df, offsets, 10, 13).collect()) == [941202, 941203, 941204]


def test_codec_of_odd_texts(spark):
    got = spark.createDataFrame([("0a1",), ("",), ("0",), (None,), ("058",), ("05",), ("11" + "3" * 25,)], "s string")
    rows = [r.c for r in got.select(codec.to_string(codec.from_string(F.col("s"))).alias("c")).collect()]
    assert rows == [None, None, None, None, None, "05", "11" + "3" * 20]
    assert one(spark, a=codec.resolution(lit(None).cast("long")), b=stats.clipper_scale_factor(lit(None).cast("int"))) == (None, None)


def test_tables(spark):
    from heptagrid.operators import tables

    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (2, -9999.0), (None, None)], "k int, x double")
    assert [r[0] for r in df.select(tables.missing(F.col("x"), -9999.0)).collect()][2:] == [None, None]
    assert [r[0] for r in df.select(tables.missing(F.col("x"), float("nan"))).collect()] == [2.0, None, -9999.0, None]
    places = spark.createDataFrame([(1, 179.9, 0.0), (2, 10.0, 89.0), (3, None, 1.0)], "k int, lon double, lat double")
    assert tables.nearest(places, -179.9, 0.0).first().k == 1 and tables.nearest(places, 170.0, 89.9).first().k == 2 and tables.nearest(places.limit(0), 0.0, 0.0).count() == 0
    assert tables.distinct_pairs(df.union(df), "k", "x").first().n == 4 and tables.differences(df, df).count() == 0 and tables.differences(df, df.limit(3)).count() == 1


def test_zonal(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 5.0), (1, float("nan")), (1, None), (2, None), (None, 1.0), (None, 2.0)], "k int, x double")
    got = {r.k: r for r in zonal.zonal_stats(df, ["k"], "x").collect()}
    assert got[1]["mean"] == 3 and got[1]["count"] == 3 and got[1].majority == 2 and got[1].median == 2 and got[2]["mean"] is None
    assert got[None].majority == 1 and got[None]["count"] == 2
    assert zonal.nan_count(df, "x").first() == (8, 3)
    assert {r.k for r in zonal.zonal_mean(df, ["k"], "x").collect()} == {1, None}


def test_archive(spark, tmp_path):
    df = plane(spark).where("mono % 11 <> 3").drop("mono")
    for mode in archive.COMPRESSIONS:
        path = str(tmp_path / mode)
        archive.write_archive(df.orderBy(F.rand(1)), path, 7, ["value"], mode)
        back = archive.open_archive(spark, path)
        assert back.select("cell", "value").exceptAll(df).count() == df.exceptAll(back.select("cell", "value")).count() == 0
        zone = archive.read_zone(back, 941192 // 7**3, 3)
        plan = zone._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(mono" in plan and zone.count() == sum(x % 11 != 3 for x in range(941192, 941192 + 343))
        assert archive.read_metadata(spark, path)["refinement_level"] == 7
        with pytest.raises(FileExistsError):
            archive.write_archive(df, path, 7, ["value"], mode)
    offsets = archive.open_ranges(spark, path)
    assert offsets.agg(F.sum("n")).first()[0] == df.count()
    with pytest.raises(ValueError):
        archive.write_archive(df.union(df), str(tmp_path / "x"), 7, ["value"])
    with pytest.raises(ValueError):
        archive.write_archive(df, str(tmp_path / "y"), 6, ["value"])
    with pytest.raises(KeyError):
        archive.select_cells(back, spark.range(1).toDF("mono"), strict=True)
