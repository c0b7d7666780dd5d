"""The six neighbours of a cell: carries of generalised balanced ternary arithmetic, then turns at base cells and pentagons.

The kernel works on whole Arrow batches: digits as a matrix, one step per level, masks for the rare cases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import BODY, DIGITS, PAD, base_cell, resolution
from ..functions.mono import EXCLUDED

#: Neighbouring base cells by base cell and direction; at the poles and pentagons some come twice.
BASE_NEIGHBOURS = (
    (5, 4, 4, 2, 1, 3), (5, 0, 0, 6, 10, 2), (1, 0, 0, 7, 6, 3), (2, 0, 0, 8, 7, 4), (3, 0, 0, 9, 8, 5), (4, 0, 0, 10, 9, 1),
    (10, 2, 1, 11, 11, 7), (6, 3, 2, 11, 11, 8), (7, 4, 3, 11, 11, 9), (8, 5, 4, 11, 11, 10), (9, 1, 5, 11, 11, 6), (9, 6, 10, 8, 8, 7),
)
#: Turns on the way into a polar base cell, and, by digits, out of one.
TURNS_IN = (0, 5, 0, 1, 3, 4, 5, 4, 3, 1, 0, 0)
TURNS_OUT = (
    (0, 1, 0, 1, 0, 2), (0, 0, 0, 0, 0, 0), (0, 0, 0, 3, 2, 2), (5, 5, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (5, 0, 4, 0, 4, 0),
)
#: Carries of the addition, clockwise on odd levels and counter-clockwise on even ones.
CARRY_CW = (
    (0, 0, 0, 0, 0, 0, 0), (0, 1, 0, 1, 0, 5, 0), (0, 0, 2, 3, 0, 0, 2), (0, 1, 3, 3, 0, 0, 0), (0, 0, 0, 0, 4, 4, 6), (0, 5, 0, 0, 4, 5, 0), (0, 0, 2, 0, 6, 0, 6),
)
CARRY_CCW = (
    (0, 0, 0, 0, 0, 0, 0), (0, 1, 0, 3, 0, 1, 0), (0, 0, 2, 2, 0, 0, 6), (0, 3, 2, 3, 0, 0, 0), (0, 0, 0, 0, 4, 5, 4), (0, 1, 0, 0, 5, 5, 0), (0, 0, 6, 0, 4, 0, 6),
)
#: Digits of the addition, clockwise; counter-clockwise it is modulo 7.
DIGIT_CW = (
    (0, 1, 2, 3, 4, 5, 6), (1, 4, 3, 6, 5, 2, 0), (2, 3, 1, 4, 6, 0, 5), (3, 6, 4, 5, 0, 1, 2), (4, 5, 6, 0, 2, 3, 1), (5, 2, 0, 1, 3, 6, 4), (6, 0, 5, 2, 1, 4, 3),
)
DIGIT_CCW = tuple(tuple((a + b) % 7 for b in range(7)) for a in range(7))


def add(a: int, b: int, clockwise: bool) -> tuple[int, int]:
    """(carry, digit) of two digits."""
    return ((CARRY_CW, DIGIT_CW) if clockwise else (CARRY_CCW, DIGIT_CCW))[0][a][b], (DIGIT_CW if clockwise else DIGIT_CCW)[a][b]


def add_column(a: Column, b: Column, clockwise: bool) -> Column:
    """struct(carry, digit) of two columns of digits."""
    flat = lambda t: F.array(*[F.lit(x) for row in t for x in row])
    at = a * 7 + b
    return F.struct(F.get(flat(CARRY_CW if clockwise else CARRY_CCW), at).alias("carry"), F.get(flat(DIGIT_CW if clockwise else DIGIT_CCW), at).alias("digit"))


def _unpack(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = cells.view(np.uint64)
    shifts = np.arange(3 * (DIGITS - 1), -1, -3).astype(np.uint64)
    return (raw >> np.uint64(60)).astype(np.int64), ((raw[:, None] >> shifts) & np.uint64(7)).astype(np.int64)


def _pack(base: np.ndarray, digits: np.ndarray) -> np.ndarray:
    raw = base.astype(np.uint64) << np.uint64(60)
    for i in range(DIGITS):
        raw |= digits[:, i].astype(np.uint64) << np.uint64(3 * (DIGITS - 1 - i))
    return raw.view(np.int64)


def _lead(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (0 on) and value of the first digit that isn't 0; padding counts."""
    place = (digits != 0).argmax(1)
    return place, digits[np.arange(len(digits)), place]


def step(digits: np.ndarray, level: int, direction: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits one step on in a direction, 1 to 6, and the carry out of the base cell, for cells of one level."""
    out, carry = digits.copy(), np.full(len(digits), direction)
    for i in range(level, 0, -1):
        t, c = (DIGIT_CCW, CARRY_CCW) if i % 2 == 0 else (DIGIT_CW, CARRY_CW)
        here = out[:, i - 1]
        out[:, i - 1], carry = np.asarray(t)[here, carry], np.asarray(c)[here, carry]
    return out, carry


def _turn(digits: np.ndarray, rows: np.ndarray, turns: np.ndarray, level: int) -> None:
    factor = np.array([pow(5, k, 7) for k in range(7)])[turns]
    digits[rows, :level] = digits[rows, :level] * factor[:, None] % 7


def ring(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) neighbours by direction, and a mask of those that exist."""
    out, exist = np.zeros((len(cells), 6), np.int64), np.ones((len(cells), 6), bool)
    base, digits = _unpack(cells)
    levels = np.where((digits == PAD).any(1), (digits == PAD).argmax(1), DIGITS)
    around, excluded = np.array(BASE_NEIGHBOURS), np.array(EXCLUDED)
    for level in np.unique(levels).tolist():
        rows = np.flatnonzero(levels == level)
        b, d = base[rows], digits[rows]
        for direction in range(1, 7):
            if level == 0:
                out[rows, direction - 1] = _pack(around[b, direction - 1], d)
                exist[rows, direction - 1] = excluded[b] != direction
                continue
            nd, carry = step(d, level, direction)
            nb = np.where(carry > 0, around[b, carry - 1], b)
            polar = np.flatnonzero((carry > 0) & ((nb == 0) | (nb == 11)))
            if len(polar):
                _turn(nd, polar, np.array(TURNS_IN)[b[polar]] + np.isin(d[polar, 0], (1, 6)), level)
            leaving = np.flatnonzero((carry > 0) & ((b == 0) | (b == 11)))
            if len(leaving):
                flip = b[leaving] == 11
                x, y = (np.where(flip, 7 - v, v) for v in (d[leaving, 0], nd[leaving, 0]))
                real = (x >= 1) & (x <= 6) & (y >= 1) & (y <= 6)
                _turn(nd, leaving[real], np.array(TURNS_OUT)[x[real] - 1, y[real] - 1], level)
            pentagon = (d[:, :level] == 0).all(1)
            place, lead = _lead(d)
            factor = np.where(lead * 5 % 7 == excluded[b], 5, np.where(lead * 3 % 7 == excluded[b], 3, 1))
            to, first = _lead(nd)
            turn = np.flatnonzero(~pentagon & (factor > 1) & (first == excluded[b]) & (to < level))
            behind = np.arange(DIGITS)[None] >= to[turn, None]
            behind[:, level:] = False
            nd[turn] = np.where(behind, nd[turn] * factor[turn, None] % 7, nd[turn])
            out[rows, direction - 1] = _pack(nb, nd)
            exist[rows, direction - 1] = ~(pentagon & (excluded[b] == direction))
    return out, exist


def no_cells(cells: np.ndarray) -> np.ndarray:
    """A mask of the slots that are no cells: their first digit that isn't 0 is the one their base cell excludes."""
    base, digits = _unpack(cells)
    return _lead(digits)[1] == np.array(EXCLUDED)[np.minimum(base, len(EXCLUDED) - 1)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _neighbours(cells: pa.Array) -> pa.Array:
    known = cells.is_valid().to_numpy(zero_copy_only=False)
    values = cells.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, exist = ring(values)
    ends = np.arange(0, 6 * len(values) + 1, 6, dtype=np.int32)
    flat = pa.array(out.ravel(), mask=~exist.ravel())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~known))


def neighbours(cell: Column) -> Column:
    """Array of six ids, one per direction 1 to 6; null where a pentagon has none; null for null."""
    return _neighbours(cell)


def neighbour(cell: Column, direction: int, level: int) -> Column:
    """struct(cell, carry) of one step in a direction, by carries alone: the base cell stays, and nothing is turned."""

    @F.arrow_udf("struct<cell: bigint, carry: int>")
    def run(cells: pa.Array) -> pa.Array:
        values = cells.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        base, digits = _unpack(values)
        nd, carry = step(digits, level, direction)
        return pa.StructArray.from_arrays([pa.array(_pack(base, nd)), pa.array(carry.astype(np.int32))], names=["cell", "carry"], mask=cells.is_null())

    return run(cell)


def edges(df: DataFrame, cell: str = "cell") -> DataFrame:
    """A row per row and direction: dir (1 to 6), nbr (null where there is none); columns of these names are replaced. A row
    whose cell is null has none; rows that repeat have theirs each."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("dir", "nbr")]
    found = df.select(*kept, F.posexplode(neighbours(F.col(cell))).alias("__dir", "nbr"))
    return found.withColumn("__dir", F.col("__dir") + 1).withColumnRenamed("__dir", "dir")


def k_ring(df: DataFrame, k: int, cell: str = "cell") -> DataFrame:
    """Distinct cells at most k steps from any of df's; null cells count for nothing. Each step goes on from the one before
    alone, so the plan grows by one exchange a step, and df is read once."""
    found = df.select(cell).dropna().distinct()
    for _ in range(k):
        found = found.select(F.explode(F.array_append(neighbours(F.col(cell)), F.col(cell))).alias(cell)).dropna().distinct()
    return found


def ring_rows(cells: DataFrame, data: DataFrame, cell: str = "cell") -> DataFrame:
    """Rows of data that are one of the cells or a neighbour of one."""
    return data.join(k_ring(cells, 1, cell), cell, "left_semi")


def base_cell_neighbours_table(spark: SparkSession) -> DataFrame:
    """base, k (0 to 4), nbr: the five neighbours of each base cell, without the excluded direction."""
    rows = []
    for b, around in enumerate(BASE_NEIGHBOURS):
        kept = [x for d, x in enumerate(around, 1) if d != EXCLUDED[b]]
        rows += [(b, k, x) for k, x in enumerate(kept)]
    return spark.createDataFrame(rows, "base int, k int, nbr int")


def base_cell_neighbour(base: int, k: int) -> int | None:
    if not 0 <= base < 12:
        raise ValueError(f"no base cell {base}")
    kept = [x for d, x in enumerate(BASE_NEIGHBOURS[base], 1) if d != EXCLUDED[base]]
    return kept[k] if 0 <= k < 5 else None


def is_pentagon(cell: Column) -> Column:
    """Whether a direction has no cell: all digits up to the padding are 0. Null for null."""
    body = cell.bitwiseAND(F.lit(BODY))
    return (body.bitwiseAND(body + 1) == 0) & (F.bit_count(body) % 3 == 0)


def base_of_whole_cell(cell: Column) -> Column:
    """The base cell of an id of resolution 0; an error for others."""
    return F.when(resolution(cell) == 0, base_cell(cell)).otherwise(F.raise_error(F.lit("not a base cell")))


def boundary_accounting(df: DataFrame, cell: str = "cell") -> DataFrame:
    """One row: cells, pentagon (a direction has no cell), out_of_area (a neighbour that df lacks), boundary_only. Cells are
    counted once, however often they come; null ones aren't. An empty table gives zeros."""
    cells = df.select(cell).dropna().distinct()
    area = cells.select(F.col(cell).alias("nbr")).withColumn("inside", F.lit(1))
    joined = edges(cells, cell).join(area, "nbr", "left")
    per = joined.groupBy(cell).agg(
        F.bool_or(F.col("nbr").isNull()).alias("pentagon"), F.bool_or(F.col("nbr").isNotNull() & F.col("inside").isNull()).alias("out")
    )
    return per.agg(
        F.count("*").alias("cells"), F.count_if("pentagon").alias("pentagon"), F.count_if("out").alias("out_of_area"),
        F.count_if(F.col("out") & ~F.col("pentagon")).alias("boundary_only"),
    )
