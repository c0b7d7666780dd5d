"""Focal operators: values of the six neighbours, slope by finite differences, axis distances and their analysis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, stats
from ..functions.geodesy import geodesic_struct
from ..staging import staged
from .neighbours import edges, is_pentagon, no_cells, ring

#: Directions of each axis: its positive end, then its negative one.
AXES = {"k": (1, 6), "j": (2, 5), "i": (4, 3)}
PARENT_LEVEL = 4
MODEL_ROWS = 10 * 7**PARENT_LEVEL + 2

#: Levels between a cell and the block that it is worked on in: up to 16,807 cells, and some three percent around them.
BLOCK_LEVELS = 5
RING = ("h1", "h2", "h3", "h4", "h5", "h6")


def gather(df: DataFrame, level: int, value: str = "value", cell: str = "cell") -> DataFrame:
    """df with h1 to h6, the neighbours' values, null where the area has no such cell; and n_nbrs, how many it has.

    One exchange: each row goes to its block, and those at a block's edge, as id and value alone, to the blocks of their
    neighbours too, who are the ones that ask for them, as being neighbours goes both ways between cells. Slots that are no
    cells may have neighbours that don't have them; where these are of another block, they are looked up by key, in one more
    join that only such tables need. Blocks are then worked on one at a time. An id that comes twice is asked for with the largest of its values; a block's rows are held together, so ids that
    repeat without bound are to be aggregated first. Rows whose cell is null have no neighbours; they are dealt to all tasks, and
    not held. Columns named like the ones added are replaced.
    """
    df = df.drop(*[c for c in (*RING, "n_nbrs") if c not in (value, cell)])
    names = df.columns
    at, shift = names.index(cell), np.uint64(3 * (codec.DIGITS - max(level - BLOCK_LEVELS, 0)))
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    extra = [T.StructField("__block", T.LongType()), T.StructField("__own", T.BooleanType()), T.StructField("__h", T.DoubleType())]
    rows = df.withColumn("__h", F.col(value).cast("double"))

    def ids(column: pa.Array) -> np.ndarray:
        return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def block(cells: np.ndarray) -> np.ndarray:
        return (cells.view(np.uint64) >> shift).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, known = ids(batch.column(at)), batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            # no block of a cell is negative
            own = np.where(known, block(cells), -1 - np.arange(len(cells)) % 997 - 997 * TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(own), pa.array(np.ones(len(own), bool)), batch.columns[-1]], names=[*names, "__block", "__own", "__h"]
            )
            out, exist = ring(cells)
            other = np.sort(np.where(exist & known[:, None], block(out.ravel()).reshape(out.shape), own[:, None]), axis=1)
            first = np.ones(other.shape, bool)
            first[:, 1:] = other[:, 1:] != other[:, :-1]
            row, place = np.nonzero(first & (other != own[:, None]))
            if len(row):
                n, pick = len(row), pa.array(row)
                columns = [batch.column(at).take(pick) if k == at else pa.nulls(n, batch.schema.field(k).type) for k in range(len(names))]
                rest = [pa.array(other[row, place]), pa.array(np.zeros(n, bool)), batch.columns[-1].take(pick)]
                yield pa.RecordBatch.from_arrays([*columns, *rest], names=[*names, "__block", "__own", "__h"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ids(batch.column(0).drop_null())
            cells = cells[no_cells(cells)]
            own, (out, exist) = block(cells), ring(cells)
            row, place = np.nonzero(exist & (block(out.ravel()).reshape(out.shape) != own[:, None]))
            asked, to = out[row, place], own[row]
            back, known = ring(asked)
            unsent = ~(known & (block(back.ravel()).reshape(back.shape) == to[:, None])).any(1)
            yield pa.RecordBatch.from_arrays([pa.array(asked[unsent]), pa.array(to[unsent])], names=["__asked", "__to"])

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cells, own = ids(rows.column(at).combine_chunks()), rows.column("__own").to_numpy()
        heights = rows.column("__h").combine_chunks()
        mine = np.flatnonzero(own)
        if not len(mine):
            return
        out, exist = ring(cells[mine])
        order = np.argsort(cells, kind="stable")
        found = np.minimum(np.searchsorted(cells[order], out), len(cells) - 1)
        known = rows.column(at).is_valid().to_numpy()
        there = exist & (cells[order][found] == out) & known[mine][:, None]
        there &= heights.is_valid().to_numpy(zero_copy_only=False)[order[found]]
        taken = heights.to_numpy(zero_copy_only=False)[order[found]]
        kept = rows.take(pa.array(mine)).select(names)
        ring_columns = [pa.array(taken[:, k], mask=~there[:, k]) for k in range(6)]
        result = pa.table([*kept.columns, *ring_columns, pa.array(there.sum(1))], names=[*names, *RING, "n_nbrs"])
        yield from result.combine_chunks().to_batches()

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(len(names)).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and blocks[a] < 0:
                    yield from work(pa.Table.from_batches([batch.slice(a, b - a)]))
                    continue
                if held and b > a and held[0].column(len(names))[0].as_py() != blocks[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt, id_ = rows.mapInArrow(spread, T.StructType(fields + extra)), F.col(f"`{cell}`")
    asks = staged(df.select(id_).mapInArrow(ask, "__asked long, __to long").distinct(), "asks")
    if not asks.isEmpty():
        columns = [F.col(f"`{f.name}`") if f.name == cell else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        found = rows.where(F.col("__h").isNotNull()).join(asks, id_ == F.col("__asked"))
        dealt = dealt.union(found.select(*columns, F.col("__to").alias("__block"), F.lit(False).alias("__own"), "__h"))
    dealt = dealt.repartition("__block")
    dealt = dealt.sortWithinPartitions("__block", cell, F.col("__h").desc_nulls_last())
    ringed = [T.StructField(h, T.DoubleType()) for h in RING] + [T.StructField("n_nbrs", T.LongType())]
    return dealt.mapInArrow(by_block, T.StructType(fields + ringed))


def gather_by_join(df: DataFrame, value: str = "value", cell: str = "cell") -> DataFrame:
    """The same by an equi-join on the id and an aggregation: six rows a cell are exchanged; needs no level."""
    data = df.select(F.col(cell).alias("nbr"), F.col(value).alias("__h"))
    pairs = edges(df.select(cell), cell).where("nbr IS NOT NULL").join(data, "nbr")
    ring = pairs.groupBy(cell).agg(*[F.max(F.when(F.col("dir") == d, F.col("__h"))).alias(f"h{d}") for d in range(1, 7)], F.count("*").alias("n_nbrs"))
    return df.join(ring, cell, "left").withColumn("n_nbrs", F.coalesce("n_nbrs", F.lit(0)))


def distortion_model(lookup: DataFrame, parent: str = "parent") -> DataFrame:
    """Weights by parent: w_k, w_j, w_i, each axis' mean distance over the geometric mean."""
    return lookup.select(F.col(parent).alias("parent"), *[(F.col(f"mean_d_{a}") / F.col("mean_d_geom")).alias(f"w_{a}") for a in AXES])


def with_distances(df: DataFrame, level: int, model: DataFrame | None = None, cell: str = "cell") -> DataFrame:
    """Adds d_k, d_j, d_i: the level's centroid distance, times the weights of the cell's ancestor at level 4, or 1 where the
    model has none. A parent that the model has twice counts with its least weights. The model is sent to all tasks if it has no
    more rows than there are cells of level 4, and joined by key otherwise."""
    base = stats.cls_m(level) * stats.CENTROID_FACTOR
    if model is None:
        return df.withColumns({f"d_{a}": F.lit(base) for a in AXES})
    found = model.groupBy(F.col("parent").alias("__parent")).agg(*[F.min(f"w_{a}").alias(f"__w_{a}") for a in AXES])
    if found.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS:
        found = F.broadcast(found)
    joined = df.withColumn("__parent", codec.parent_at(F.col(cell), PARENT_LEVEL)).join(found, "__parent", "left")
    return joined.withColumns({f"d_{a}": F.lit(base) * F.coalesce(f"__w_{a}", F.lit(1.0)) for a in AXES}).drop("__parent", *[f"__w_{a}" for a in AXES])


def directions(df: DataFrame, centroids: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, dir, nbr, distance (m) and bearing (degrees, -180 to 180) from each cell to its neighbours. centroids: cell, lon, lat.

    A row per cell of df and direction that has a cell; distance and bearing are null where a centroid is missing. Cells are
    taken once, null ones not at all; of a cell's centroids the least counts.
    """
    pairs = edges(df.select(F.col(cell).alias("cell")).dropna().distinct()).where("nbr IS NOT NULL")
    known = centroids.groupBy("cell").agg(F.min(F.struct("lon", "lat")).alias("at"))
    here = known.select("cell", F.col("at.lon").alias("x1"), F.col("at.lat").alias("y1"))
    there = known.select(F.col("cell").alias("nbr"), F.col("at.lon").alias("x2"), F.col("at.lat").alias("y2"))
    far = pairs.join(here, "cell", "left").join(there, "nbr", "left")
    far = far.withColumn("g", geodesic_struct(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return far.select("cell", "dir", "nbr", "g.distance", (F.pmod(F.col("g.azimuth") + 180, F.lit(360.0)) - 180).alias("bearing"))


def axis_distances(df: DataFrame, centroids: DataFrame, cell: str = "cell", skip_missing: bool = False) -> DataFrame:
    """cell, d_k, d_j, d_i: a row per cell, each axis' mean of the distances to both its ends. An axis with an end missing is
    null; with ``skip_missing`` the other end's distance counts alone."""
    far = directions(df, centroids, cell)
    ends = far.groupBy("cell").agg(*[F.max(F.when(F.col("dir") == k, F.col("distance"))).alias(f"e{k}") for k in range(1, 7)])
    mean = []
    for axis, (a, b) in AXES.items():
        both = (F.col(f"e{a}") + F.col(f"e{b}")) / 2
        mean.append((F.coalesce(both, f"e{a}", f"e{b}") if skip_missing else both).alias(f"d_{axis}"))
    return ends.select("cell", *mean)


def with_geodesic_distances(df: DataFrame, centroids: DataFrame, cell: str = "cell", skip_missing: bool = False) -> DataFrame:
    """Adds d_k, d_j, d_i of :func:`axis_distances`."""
    found = axis_distances(df, centroids, cell, skip_missing).withColumnRenamed("cell", "__at")
    return df.join(found, F.col(cell) == F.col("__at"), "left").drop("__at")


def axis_sweep(df: DataFrame, centroids: DataFrame, cell: str = "cell", pentagons: bool = False) -> DataFrame:
    """cell, d_k, d_j, d_i and :func:`axis_metrics` of all cells of df, but pentagons unless asked for; ends without a centroid,
    and the direction that a pentagon lacks, don't count."""
    swept = df if pentagons else df.where(~is_pentagon(F.col(cell)))
    return axis_metrics(axis_distances(swept, centroids, cell, skip_missing=True))


def sweep_by_parent(sweep: DataFrame, level: int = PARENT_LEVEL) -> DataFrame:
    """Per ancestor: n, means and sample deviations of d_k, d_j, d_i, mean_d_geom, mean_squeeze, min_squeeze, and the most
    frequent squeezed axis, of equals k before j before i. It is the lookup table of a distortion model."""
    of = [f(f"d_{a}").alias(f"{n}_d_{a}") for a in AXES for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    axes = [F.struct(F.count_if(F.col("squeezed_axis") == a).alias("n"), F.lit(-k).alias("k"), F.lit(a).alias("axis")) for k, a in enumerate(AXES)]
    return sweep.groupBy(codec.parent_at(F.col("cell"), level).alias("parent")).agg(
        F.count("*").alias("n"), *of, F.avg("d_geom_mean").alias("mean_d_geom"), F.avg("squeeze_ratio").alias("mean_squeeze"),
        F.min("squeeze_ratio").alias("min_squeeze"), F.greatest(*axes)["axis"].alias("modal_squeezed_axis"),
    )


def slope_column() -> Column:
    """Metres by metres, from h1 to h6 and d_k, d_j, d_i; null unless all six neighbours are there. NaN stays NaN."""
    h = [F.col(f"h{d}").cast("double") for d in range(1, 7)]
    dx = (h[0] - h[5]) / (2 * F.col("d_k"))
    dy = (h[3] + h[4] - h[1] - h[2]) / (2 * math.sqrt(3) * (F.col("d_j") + F.col("d_i")) / 2)
    return F.when(F.col("n_nbrs") == 6, F.hypot(dx, dy))


def slope(
    df: DataFrame, level: int, model: DataFrame | None = None, mode: str = "lookup", centroids: DataFrame | None = None, value: str = "value", cell: str = "cell"
) -> DataFrame:
    """df with slope. mode: lookup (needs a model), isotropic, or geodesic (needs centroids). Partitions don't matter.

    Null where the value is null or a neighbour is missing, so for pentagons and null cells; NaN where the value is NaN.
    Repeated rows are each kept; a column named slope is replaced, any other is left as it is. An empty table gives none.
    """
    if mode not in ("lookup", "isotropic", "geodesic"):
        raise ValueError(f"no mode {mode}")
    if mode == "lookup" and model is None or mode == "geodesic" and centroids is None:
        raise ValueError(f"{mode} needs its table")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "slope"]).alias("__row")
    packed = df.select(whole, F.col(f"`{cell}`").alias("__cell"), F.col(f"`{value}`").cast("double").alias("__value"))
    ringed = gather(packed, level, "__value", "__cell")
    if mode == "geodesic":
        with_d = with_geodesic_distances(ringed, centroids, "__cell")
    else:
        with_d = with_distances(ringed, level, model if mode == "lookup" else None, "__cell")
    # heights are differences to the cell's own, so without that, or with NaN, there is none
    own = F.col("__value")
    found = F.when(F.isnan(own), F.lit(float("nan"))).when(own.isNotNull(), slope_column())
    return with_d.select("__row.*", found.alias("slope"))


def slope_variants(df: DataFrame, level: int, centroids: DataFrame, value: str = "value", cell: str = "cell") -> DataFrame:
    """cell and four slopes of the same heights: by the directions 1 to 4 and 2, 3 to 5, 6 as axes (paper), by this grid's axes,
    both with the level's characteristic length for distance (axes), with each axis' geodesic distances (geodesic), and of the
    plane fitted to the six neighbours by distance and bearing (plane). Cells with six neighbours of known height and place."""
    ringed = gather(df.select(F.col(cell).alias("cell"), F.col(value).cast("double").alias("value")), level).where("n_nbrs = 6 AND value IS NOT NULL")
    far = directions(df, centroids, cell).groupBy("cell")
    far = far.agg(*[F.max(F.when(F.col("dir") == k, F.col(c))).alias(f"{c[0]}{k}") for k in range(1, 7) for c in ("distance", "bearing")])
    h, d = [F.col(f"h{k}") for k in range(1, 7)], [F.col(f"d{k}") for k in range(1, 7)]
    one, root = F.lit(stats.cls_m(level)), 2 * math.sqrt(3)
    dy = (d[1] + d[2] + d[3] + d[4]) / 4
    east = [x * F.sin(F.radians(f"b{k}")) for k, x in enumerate(d, 1)]
    north = [x * F.cos(F.radians(f"b{k}")) for k, x in enumerate(d, 1)]
    rise = [x - F.col("value") for x in h]
    dot = lambda x, y: sum((a * b for a, b in zip(x[1:], y[1:])), x[0] * y[0])
    ee, nn, en, eh, nh = dot(east, east), dot(north, north), dot(east, north), dot(east, rise), dot(north, rise)
    det = ee * nn - en * en
    plane = F.when(det != 0, F.hypot((eh * nn - nh * en) / det, (nh * ee - eh * en) / det))
    across = h[3] + h[4] - h[1] - h[2]
    return ringed.join(far, "cell").select(
        "cell", F.hypot((h[0] - h[3]) / (2 * one), (h[1] + h[2] - h[4] - h[5]) / (root * one)).alias("paper"),
        F.hypot((h[0] - h[5]) / (2 * one), across / (root * one)).alias("axes"),
        F.hypot((h[0] - h[5]) / (d[0] + d[5]), across / (root * dy)).alias("geodesic"), plane.alias("plane"),
    )


def relative_error(found: Column, exact: Column, least: float = 1e-9) -> Column:
    """In percent; null where the exact value is not over the least."""
    return F.when(exact > least, (found - exact) / exact * 100)


def surfaces(df: DataFrame, x: Column, y: Column, east: float, north: float, bend: float) -> DataFrame:
    """Adds heights and slopes of a tilted plane (plane, plane_slope) and a paraboloid (bowl, bowl_slope) at x, y in metres."""
    flat = F.lit(math.hypot(east, north))
    return df.withColumns({"plane": x * east + y * north, "plane_slope": flat, "bowl": (x * x + y * y) * bend, "bowl_slope": F.hypot(x, y) * (2 * abs(bend))})


def parity_gap(df: DataFrame, level: str = "level", error: str = "error", most: float = 0.5) -> DataFrame:
    """One row: even, odd (mean error of the levels of each kind), gap, and whether it is within ``most``."""
    even = F.pmod(F.col(level), F.lit(2)) == 0
    found = df.agg(F.avg(F.when(even, F.col(error))).alias("even"), F.avg(F.when(~even, F.col(error))).alias("odd"))
    return found.withColumn("gap", F.abs(F.col("even") - F.col("odd"))).withColumn("within", F.col("gap") <= most)


def slope_degrees(slope_: Column) -> Column:
    return F.degrees(F.atan(slope_))


def plane_fit(df: DataFrame, key: str, east: str = "east", north: str = "north", dh: str = "dh") -> DataFrame:
    """Least squares of dh = a east + b north by key: a, b and slope, from five sums of an aggregation."""
    e, n, h = F.col(east), F.col(north), F.col(dh)
    sums = df.groupBy(key).agg(F.sum(e * e).alias("ee"), F.sum(e * n).alias("en"), F.sum(n * n).alias("nn"), F.sum(e * h).alias("eh"), F.sum(n * h).alias("nh"))
    det = F.col("ee") * F.col("nn") - F.col("en") * F.col("en")
    a = F.when(det != 0, (F.col("eh") * F.col("nn") - F.col("nh") * F.col("en")) / det)
    b = F.when(det != 0, (F.col("nh") * F.col("ee") - F.col("eh") * F.col("en")) / det)
    return sums.select(key, a.alias("a"), b.alias("b"), F.hypot(a, b).alias("slope"))


def axis_metrics(df: DataFrame) -> DataFrame:
    """Adds means, extremes, squeeze_ratio (least by greatest) and squeezed_axis (k before j before i) of d_k, d_j, d_i."""
    d = [F.col(f"d_{a}") for a in AXES]
    least = F.least(*d)
    axis = F.when(d[0] == least, "k").when(d[1] == least, "j").otherwise("i")
    geom = F.cbrt(d[0] * d[1] * d[2])
    return df.withColumns(
        {"d_geom_mean": geom, "d_arith_mean": (d[0] + d[1] + d[2]) / 3, "d_min": least, "d_max": F.greatest(*d), "squeeze_ratio": least / F.greatest(*d), "squeezed_axis": F.when(least.isNotNull(), axis)}
    )


def _ranked(largest: bool) -> Column:
    """Axes by mean: of equals, the order i, j, k. struct(m, place, axis, s)."""
    found = [
        F.struct((-F.col(f"mean_d_{a}") if largest else F.col(f"mean_d_{a}")).alias("m"), F.lit(p).alias("place"), F.lit(a).alias("axis"), F.col(f"std_d_{a}").alias("s"))
        for p, a in enumerate("ijk")
    ]
    return F.sort_array(F.array(*found))


def dominant_axis(df: DataFrame, ratio: float = 1.5, use_std: bool = False, std_mult: float = 2.0) -> DataFrame:
    """Adds axis (null if none is longer than the others' mean by the ratio) and ratio."""
    r = _ranked(True)
    m = [-F.get(r, F.lit(k))["m"] for k in range(3)]
    s = [F.get(r, F.lit(k))["s"] for k in range(2)]
    others = (m[1] + m[2]) / 2
    ratio_ = F.when(others > 0, m[0] / others).otherwise(F.lit(float("inf")))
    dominates = ratio_ >= ratio
    if use_std:
        dominates &= m[0] > m[1] + std_mult * F.sqrt(s[0] * s[0] + s[1] * s[1])
    return df.withColumns({"axis": F.when(dominates, F.get(r, F.lit(0))["axis"]), "ratio": ratio_})


def dominant_axis_twosided(df: DataFrame, min_rel_diff: float = 0.02, z: float = 2.0, use_avg_others: bool = False) -> DataFrame:
    """Adds axis and side (high or low), null where no axis stands out from the middle one, or the mean of both others."""
    r = _ranked(False)
    m, s, axis = ([F.get(r, F.lit(k))[name] for k in range(3)] for name in ("m", "s", "axis"))
    apart = lambda a, b: m[a] - m[b] >= z * F.sqrt(s[a] * s[a] + s[b] * s[b])
    below, above = ((m[1] + m[0]) / 2, (m[1] + m[2]) / 2) if use_avg_others else (m[1], m[1])
    inf = F.lit(float("inf"))
    high = (F.when(below > 0, m[2] / below).otherwise(inf) >= 1 + min_rel_diff) & apart(2, 1)
    low = (F.when(m[0] > 0, above / m[0]).otherwise(inf) >= 1 + min_rel_diff) & apart(1, 0)
    return df.withColumns({"axis": F.when(high, axis[2]).when(low, axis[0]), "side": F.when(high, "high").when(low, "low")})
