"""SQL for DuckDB with the results of :mod:`heptagrid.plans.queries`, written in terms of unsigned shifts and lists."""

from __future__ import annotations

from ..functions import latitudes, mono, stats
from ..operators import neighbours as N

FACTOR = stats.CENTROID_FACTOR
#: Clockwise digits add modulo 7 under these names.
CW = "[0, 1, 4, 5, 2, 3, 6]"


def digit(m: str, level: int, i: int) -> str:
    return f"(({m}) // {7 ** (level - i)}) % 7"


def packed(base: str, digits: list[str]) -> str:
    """The id as UBIGINT."""
    parts = [f"(CAST({base} AS UBIGINT) << 60)"] + [f"(CAST({x} AS UBIGINT) << {60 - 3 * i})" for i, x in enumerate(digits, 1)]
    return "(" + " | ".join([*parts, f"CAST({(1 << 3 * (20 - len(digits))) - 1} AS UBIGINT)"]) + ")"


def unsigned(m: str, level: int) -> str:
    return packed(f"({m}) // {7**level}", [digit(m, level, i) for i in range(1, level + 1)])


def signed(u: str) -> str:
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN CAST(CAST({u} AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST({u} AS BIGINT) END)"


def bits(u: str, i: int) -> str:
    return f"CAST(({u} >> {60 - 3 * i}) & 7 AS INTEGER)"


def valid(m: str, level: int) -> str:
    first = " ".join(f"WHEN {digit(m, level, i)} <> 0 THEN {digit(m, level, i)}" for i in range(1, level + 1))
    return f"((CASE {first} ELSE -1 END) <> (CASE WHEN ({m}) // {7**level} < 6 THEN {mono.EXCLUDED[0]} ELSE {mono.EXCLUDED[6]} END))"


def listed(rows) -> str:
    return "[" + ", ".join(str(x) for row in rows for x in row) + "]"


AOI = f"aoi AS (SELECT event_id, 941192 + event_id AS mono, {signed(unsigned('941192 + event_id', 7))} AS cell, value, event_type FROM events)"
HOLES = AOI + ", holes AS (SELECT * FROM aoi WHERE event_type <> 'error')"
EARTH = f"""slot AS (SELECT o_orderkey, o_totalprice, (o_orderkey * 7919) % 1411788 AS mono FROM orders),
earth AS (SELECT *, {unsigned('mono', 6)} AS u, {signed(unsigned('mono', 6))} AS cell FROM slot WHERE {valid('mono', 6)})"""
PIXELS = "pixels AS (SELECT 941192 + l_orderkey % 16807 AS mono, l_extendedprice AS x, l_quantity AS q FROM lineitem)"
LONLAT = "lonlat AS (SELECT c_custkey, c_nationkey, CAST(c_custkey * 37 % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 53 % 360 - 180 AS DOUBLE) AS lon FROM customer)"
RANGES = HOLES + """, flagged AS (SELECT mono, CASE WHEN mono = lag(mono) OVER (ORDER BY mono) + 1 THEN 0 ELSE 1 END AS gap FROM holes),
island AS (SELECT mono, sum(gap) OVER (ORDER BY mono) AS i FROM flagged),
found AS (SELECT min(mono) AS "start", max(mono) AS "end" FROM island GROUP BY i),
sized AS (SELECT "start", "end", "end" - "start" + 1 AS n FROM found),
placed AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized)"""
STATS = "stats AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r}, CAST({10 * 7**r + 2} AS BIGINT), CAST({s['area_km2']!r} AS DOUBLE), CAST({s['area_m2']!r} AS DOUBLE), CAST({s['cls_km']!r} AS DOUBLE), CAST({s['cls_m']!r} AS DOUBLE))"
    for r, s in ((r, stats.resolution_stats(r)) for r in range(21))
) + ") AS t(resolution, num_cells, area_km2, area_m2, cls_km, cls_m))"


def ring_ctes(source: str, keep: str, level: int, name: str = "ring") -> str:
    """CTEs that end in ``name``: keep, mono, dir, nbr (signed, null where there is none). source has keep and mono."""
    digits = ", ".join(f"CAST({digit('mono', level, i)} AS INTEGER) AS d{i}" for i in range(1, level + 1))
    at = [f"r0 AS (SELECT {keep}, mono, CAST(dir AS INTEGER) AS dir, CAST(dir AS INTEGER) AS c, CAST(mono // {7**level} AS INTEGER) AS b, {digits} FROM {source}, range(1, 7) AS t(dir))"]
    for k, i in enumerate(range(level, 0, -1), 1):
        t, c = (N.DIGIT_CCW, N.CARRY_CCW) if i % 2 == 0 else (N.DIGIT_CW, N.CARRY_CW)
        at.append(f"r{k} AS (SELECT * REPLACE (({listed(c)})[d{i} * 7 + c + 1] AS c), ({listed(t)})[d{i} * 7 + c + 1] AS n{i} FROM r{k - 1})")
    powers = "[1, 5, 4, 6, 2, 3, 1]"
    turned = lambda f: "REPLACE (" + ", ".join(f"n{i} * {f} % 7 AS n{i}" for i in range(1, level + 1)) + ")"
    lead = lambda p: "CASE " + " ".join(f"WHEN {p}{i} <> 0 THEN {p}{i}" for i in range(1, level + 1)) + " ELSE 0 END"
    e = "(CASE WHEN b < 6 THEN 2 ELSE 5 END)"
    around = "[" + ", ".join(str(x) for row in N.BASE_NEIGHBOURS for x in row) + "]"
    at += [
        f"x1 AS (SELECT *, CASE WHEN c > 0 THEN ({around})[b * 6 + c] ELSE b END AS nb FROM r{level})",
        f"x2 AS (SELECT *, CASE WHEN c > 0 AND nb IN (0, 11) THEN ({powers})[({list(N.TURNS_IN)})[b + 1] + CAST(d1 IN (1, 6) AS INTEGER) + 1] ELSE 1 END AS f FROM x1)",
        f"x3 AS (SELECT * {turned('f')} FROM x2)",
        "x4 AS (SELECT *, CASE WHEN b = 11 THEN 7 - d1 ELSE d1 END AS x, CASE WHEN b = 11 THEN 7 - n1 ELSE n1 END AS y FROM x3)",
        f"x5 AS (SELECT * REPLACE (CASE WHEN c > 0 AND b IN (0, 11) AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN ({powers})[({listed(N.TURNS_OUT)})[(x - 1) * 6 + y] + 1] ELSE 1 END AS f) FROM x4)",
        f"x6 AS (SELECT * {turned('f')} FROM x5)",
        f"x7 AS (SELECT *, {lead('d')} AS z, {lead('n')} AS lead FROM x6)",
        f"x8 AS (SELECT * REPLACE (CASE WHEN z = 0 OR lead <> {e} THEN 1 WHEN z * 5 % 7 = {e} THEN 5 WHEN z * 3 % 7 = {e} THEN 3 ELSE 1 END AS f) FROM x7)",
        f"x9 AS (SELECT * {turned('f')} FROM x8)",
        f"{name} AS (SELECT {keep}, mono, dir, CASE WHEN z = 0 AND dir = {e} THEN NULL ELSE {signed(packed('nb', [f'n{i}' for i in range(1, level + 1)]))} END AS nbr FROM x9)",
    ]
    return ", ".join(at)


def series(angle: str, coefficients: list[float]) -> str:
    return " + ".join(f"({c!r}) * sin({2 * (k + 1)} * {angle})" for k, c in enumerate(coefficients))


def latitude(coefficients: list[float], name: str) -> str:
    return f"WITH {LONLAT} SELECT c_custkey, round(degrees(radians(lat) + {series('radians(lat)', coefficients)}), 9) AS {name} FROM lonlat"


def find(prefer: str) -> str:
    test = {"closest": "true", "larger": "cls_m >= t", "smaller": "cls_m <= t"}[prefer]
    return f"""WITH {STATS}, target AS (SELECT c_custkey, abs(c_acctbal) + 1 AS t FROM customer)
SELECT c_custkey, (SELECT resolution FROM stats WHERE {test} ORDER BY abs(cls_m - t), resolution LIMIT 1) AS resolution FROM target"""


FIRST = " ".join(f"WHEN {bits('u', i)} <> 0 THEN {i}" for i in range(1, 21))
RES = " ".join(f"WHEN {bits('u', i)} = 7 THEN {i - 1}" for i in range(1, 21))
TEXT = "lpad(CAST(u >> 60 AS VARCHAR), 2, '0') || " + " || ".join(f"CAST({bits('u', i)} AS VARCHAR)" for i in range(1, 7))
LOOKUP = f"""lookup AS (SELECT {941192 // 7**3} + k AS m, 62608.1 + k % 5 AS dk, 58689.2 - k % 7 AS dj, 56756.2 + k % 3 AS di, 59301.7 AS dg FROM range(343) AS t(k) WHERE k % 3 <> 0)"""
GATHER = (
    HOLES + ", " + ring_ctes("holes", "event_id", 7)
    + """, pairs AS (SELECT r.event_id, r.dir, h.value AS h FROM ring r JOIN holes h ON r.nbr = h.cell),
six AS (SELECT event_id, count(*) AS n, """
    + ", ".join(f"max(CASE WHEN dir = {k} THEN h END) AS h{k}" for k in range(1, 7))
    + " FROM pairs GROUP BY event_id)"
)
BASE = stats.cls_m(7) * FACTOR


def slope(dk: str, dj: str, di: str) -> str:
    return f"CASE WHEN n = 6 THEN sqrt(pow((h1 - h6) / (2 * {dk}), 2) + pow((h4 + h5 - h2 - h3) / (2 * sqrt(3) * ({dj} + {di}) / 2), 2)) END"


AXES = """axes AS (SELECT s_suppkey, 10 + (s_suppkey * 3 % 7) / 4 AS mi, 10 + (s_suppkey * 5 % 7) / 4 AS mj, 10 + (s_suppkey * 11 % 7) / 4 AS mk,
  0.1::DOUBLE + (s_suppkey * 2 % 3) / 10 AS si, 0.1::DOUBLE + (s_suppkey * 7 % 3) / 10 AS sj, 0.1::DOUBLE + (s_suppkey * 13 % 3) / 10 AS sk FROM supplier),
long AS (SELECT s_suppkey, 'i' AS axis, 0 AS p, mi AS m, si AS s FROM axes UNION ALL SELECT s_suppkey, 'j', 1, mj, sj FROM axes UNION ALL SELECT s_suppkey, 'k', 2, mk, sk FROM axes)"""
RANK_DOWN = "ranked AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY m DESC, p) AS r FROM long)"
RANK_UP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY m, p) AS r FROM long)"
WIDE = "wide AS (SELECT s_suppkey, " + ", ".join(f"max(CASE WHEN r = {k} THEN {c} END) AS {c}{k}" for k in (1, 2, 3) for c in ("axis", "m", "s")) + " FROM ranked GROUP BY s_suppkey)"



def geodesic_ctes(source: str, keep: str, name: str = "geo", rounds: int = 12) -> str:
    """CTEs that end in ``name``: keep, distance, azimuth (0 up to 360). source: keep, x1, y1, x2, y2 in degrees."""
    a, f = 6378137.0, 1 / 298.257223563
    at = [
        f"g0 AS (SELECT {keep}, atan({1 - f!r} * tan(radians(y1))) AS u1, atan({1 - f!r} * tan(radians(y2))) AS u2, radians(x2) - radians(x1) AS w, "
        f"sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, w AS t FROM {source})"
    ]
    for k in range(1, rounds + 1):
        at.append(
            f"g{k} AS (SELECT {keep}, w, s1, c1, s2, c2, sqrt(pow(c2 * sin(t), 2) + pow(c1 * s2 - s1 * c2 * cos(t), 2)) AS si, s1 * s2 + c1 * c2 * cos(t) AS co, "
            f"atan2(si, co) AS arc, CASE WHEN si > 0 THEN c1 * c2 * sin(t) / si ELSE 0 END AS sa, 1 - sa * sa AS ca, CASE WHEN ca > 1e-15 THEN co - 2 * s1 * s2 / ca ELSE 0 END AS mid, "
            f"{f / 16!r} * ca * (4 + {f!r} * (4 - 3 * ca)) AS q, w + (1 - q) * {f!r} * sa * (arc + q * si * (mid + q * co * (2 * mid * mid - 1))) AS t2 FROM g{k - 1}), "
            f"h{k} AS (SELECT * RENAME (t2 AS t) FROM g{k})"
        )
    sql = ", ".join(at)
    for k in range(2, rounds + 1):
        sql = sql.replace(f"FROM g{k - 1}), h{k} AS", f"FROM h{k - 1}), h{k} AS")
    b = a * (1 - f)
    return sql + (
        f", g_end AS (SELECT *, ca * {(a * a - b * b) / (b * b)!r} AS u, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, "
        f"u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small, small * si * (mid + small / 4 * (co * (2 * mid * mid - 1) - small / 6 * mid * (4 * si * si - 3) * (4 * mid * mid - 3))) AS off, "
        f"degrees(atan2(c2 * sin(t), c1 * s2 - s1 * c2 * cos(t))) AS z FROM h{rounds}), "
        f"{name} AS MATERIALIZED (SELECT {keep}, {b!r} * big * (arc - off) AS distance, CASE WHEN z < 0 THEN z + 360 ELSE z END AS azimuth, z FROM g_end)"
    )


def mono_of(cell: str, level: int) -> str:
    """A cell's number from its signed id."""
    u = f"(CASE WHEN {cell} < 0 THEN CAST(CAST({cell} AS HUGEINT) + 18446744073709551616 AS UBIGINT) ELSE CAST({cell} AS UBIGINT) END)"
    return f"(CAST({u} >> 60 AS BIGINT) * {7**level} + " + " + ".join(f"CAST(({u} >> {60 - 3 * i}) & 7 AS BIGINT) * {7 ** (level - i)}" for i in range(1, level + 1)) + ")"


def rings(k: int) -> str:
    """Cells at most k steps from the area."""
    found = f"SELECT cell FROM (WITH {HOLES} SELECT cell FROM holes)"
    for _ in range(k):
        found = (
            f"SELECT cell FROM (WITH had AS ({found}), line AS (SELECT 1 AS one, {mono_of('cell', 7)} AS mono FROM had), {ring_ctes('line', 'one', 7)} "
            "SELECT cell FROM had UNION SELECT nbr FROM ring WHERE nbr IS NOT NULL)"
        )
    return found


PLACES = "places AS (SELECT event_id, mono, cell, value, (mono % 997) * 0.003::DOUBLE + 24 AS lon, (mono * 7919 % 991) * 0.002::DOUBLE + 58 AS lat FROM aoi)"
DIRECTED = (
    HOLES + ", " + PLACES + ", " + ring_ctes("holes", "cell", 7)
    + """, paired AS (SELECT r.cell, r.dir, r.nbr, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM ring r JOIN places a ON r.cell = a.cell LEFT JOIN places b ON r.nbr = b.cell WHERE r.nbr IS NOT NULL), """
    + geodesic_ctes("paired", "cell, dir, nbr")
)
ENDS = "ends AS MATERIALIZED (SELECT cell, " + ", ".join(f"max(CASE WHEN dir = {k} THEN distance END) AS e{k}, max(CASE WHEN dir = {k} THEN z END) AS z{k}" for k in range(1, 7)) + " FROM geo GROUP BY cell)"
HEIGHTS = (
    "high AS (SELECT g.cell, g.dir, h.value AS h FROM geo g JOIN holes h ON g.nbr = h.cell WHERE h.value IS NOT NULL), wide6 AS (SELECT cell, count(*) AS n, "
    + ", ".join(f"max(CASE WHEN dir = {k} THEN h END) AS h{k}" for k in range(1, 7))
    + " FROM high GROUP BY cell)"
)
SWEEP = (
    DIRECTED + ", " + ENDS
    + ", axial AS MATERIALIZED (SELECT cell, " + ", ".join(f"coalesce((e{x} + e{y}) / 2, e{x}, e{y}) AS {n}" for n, x, y in (("k", 1, 6), ("j", 2, 5), ("i", 4, 3))) + " FROM ends), "
    + "swept AS MATERIALIZED (SELECT *, cbrt(k * j * i) AS geom, least(k, j, i) / greatest(k, j, i) AS squeeze, CASE WHEN k = least(k, j, i) THEN 'k' WHEN j = least(k, j, i) THEN 'j' WHEN i = least(k, j, i) THEN 'i' END AS axis FROM axial)"
)
BY_PARENT = SWEEP + f""", lined AS MATERIALIZED (SELECT *, {mono_of('cell', 7)} // 343 AS m FROM swept), by_parent AS (SELECT {signed(unsigned('m', 4))} AS parent, count(*) AS n, avg(k) AS mean_d_k, stddev_samp(k) AS std_d_k,
avg(j) AS mean_d_j, avg(i) AS mean_d_i, avg(geom) AS mean_d_geom, avg(squeeze) AS mean_squeeze, min(squeeze) AS min_squeeze,
CASE WHEN count(*) FILTER (axis = 'k') >= greatest(count(*) FILTER (axis = 'j'), count(*) FILTER (axis = 'i')) THEN 'k' WHEN count(*) FILTER (axis = 'j') >= count(*) FILTER (axis = 'i') THEN 'j' ELSE 'i' END AS modal_squeezed_axis FROM lined GROUP BY m)"""
XY = "xy AS (SELECT *, (lon - 25.5) * (111320 * cos(radians(59))) AS x, (lat - 59) * 111320 AS y FROM places)"
FLAT = "sqrt(0.05::DOUBLE * 0.05 + 0.03::DOUBLE * 0.03)"

ORACLES = {
    "stats_lookup": f"WITH {STATS} SELECT * FROM stats",
    **{f"find_resolution_{p}": find(p) for p in ("closest", "larger", "smaller")},
    "scale_and_spacing": f"""WITH {STATS} SELECT c_custkey, CAST(CASE WHEN c_custkey % 21 <= 8 THEN 1000000 WHEN c_custkey % 21 <= 11 THEN 10000000 ELSE 100000000 END AS BIGINT) AS factor,
round(cls_km * sqrt(pi() / (2 * sqrt(3))), 6) AS spacing FROM customer JOIN stats ON resolution = c_custkey % 21""",
    "encode_id": f"WITH {EARTH} SELECT o_orderkey, cell FROM earth",
    "decode_base_digit": f"""WITH {EARTH} SELECT o_orderkey, CAST(u >> 60 AS INTEGER) AS base, {bits('u', 1)} AS d1, {bits('u', 6)} AS d6, {bits('u', 7)} AS d7,
CASE {RES} ELSE 20 END AS resolution, CASE WHEN {bits('u', 1)} = 7 THEN 0 {FIRST} ELSE 0 END AS first, {" || ".join(f"CAST({bits('u', i)} AS VARCHAR)" for i in range(1, 21))} AS digits FROM earth""",
    "encode_digits": f"SELECT p_partkey, {signed(packed('p_partkey % 12', [f'p_partkey * {m} % 7' for m in (1, 3, 5)]))} AS cell FROM part",
    "parent_level": f"WITH {EARTH} SELECT o_orderkey, " + ", ".join(f"{signed(f'(u | CAST({(1 << 3 * (20 - r)) - 1} AS UBIGINT))')} AS {n}" for n, r in (("p0", 0), ("p3", 3), ("p9", 9), ("up", 5))) + " FROM earth",
    "hex_and_string": f"WITH {EARTH} SELECT o_orderkey, printf('%016x', u) AS hex, {TEXT} AS text, 6 AS resolution, cell AS from_hex, cell AS from_string, 6 AS length FROM earth",
    "local_pos": f"""WITH {EARTH}, s AS (SELECT o_orderkey, {TEXT} AS t FROM earth) SELECT o_orderkey, left(t, 7) AS parent, right(t, 1) AS local, right(t, 1) = '0' AS is_center FROM s""",
    "uint64_ids": "SELECT o_orderkey, -1 - (o_orderkey * 1234567) % 1000000007 AS cell FROM orders",
    "base7_strings": "SELECT o_orderkey, " + " || ".join(f"CAST((o_orderkey // {7**k}) % 7 AS VARCHAR)" for k in range(8, -1, -1)) + " AS text, o_orderkey AS back FROM orders",
    "to_mono": f"WITH {EARTH} SELECT o_orderkey, mono, mono // 2401 AS mono2 FROM earth",
    "from_mono": f"WITH s AS (SELECT o_orderkey, (o_orderkey * 104729) % {12 * 7**12} AS m FROM orders) SELECT o_orderkey, {signed(unsigned('m', 12))} AS cell FROM s",
    "valid_cells": f"WITH {EARTH} SELECT o_orderkey, {valid('mono', 6)} AS valid FROM slot",
    "children": f"WITH c AS (SELECT p_partkey AS m, p_partkey * 7 + k AS child FROM part, range(7) AS t(k)) SELECT * FROM c WHERE {valid('child', 5)}",
    "descendants_k": f"""WITH c AS (SELECT s_suppkey AS m, s_suppkey * 343 + k AS child FROM supplier, range(343) AS t(k))
SELECT m, count(*) AS n, min(child) AS first, max(child) AS last FROM c WHERE {valid('child', 6)} GROUP BY m""",
    "unique_ancestors": f"WITH {EARTH} SELECT DISTINCT mono // 343 AS ancestor FROM earth",
    "holes_count": f"SELECT count(*) AS slots, count(*) FILTER ({valid('m', 4)}) AS cells, count(*) FILTER (NOT {valid('m', 4)}) AS holes FROM range({12 * 7**4}) AS t(m)",
    "authalic_lat": latitude(latitudes.series(latitudes.WGS84_F, latitudes.TO_AUTHALIC), "authalic"),
    "geodetic_lat": latitude(latitudes.series(latitudes.WGS84_F, latitudes.TO_GEODETIC), "geodetic"),
    "custom_ellipsoid_lat": latitude(latitudes.series(1 / 300, latitudes.TO_AUTHALIC), "authalic"),
    "circular_stats": f"""WITH {LONLAT}, m AS (SELECT c_nationkey, avg(cos(radians(lon))) AS c, avg(sin(radians(lon))) AS s FROM lonlat GROUP BY c_nationkey)
SELECT c_nationkey, round((degrees(atan2(s, c)) + 360) % 360, 6) AS mean, round(degrees(sqrt(greatest(-2 * ln(sqrt(c * c + s * s)), 0))), 6) AS std FROM m""",
    "local_xy": f"""WITH {LONLAT} SELECT c_custkey, round((lon - 24) * 111320 * cos(radians(58)), 4) AS x, round((lat - 58) * 111320, 4) AS y, (lon - lat + 540 + 360) % 360 - 180 AS turn FROM lonlat""",
    "gbt_add": f"""SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, ({listed(N.CARRY_CW)})[a * 7 + b + 1] AS cw_carry, ({CW})[(({CW})[a + 1] + ({CW})[b + 1]) % 7 + 1] AS cw_digit,
({listed(N.CARRY_CCW)})[a * 7 + b + 1] AS ccw_carry, CAST((a + b) % 7 AS INTEGER) AS ccw_digit FROM range(7) AS x(a), range(7) AS y(b)""",
    "base_cell_neighbours": f"""WITH a AS (SELECT CAST(b AS INTEGER) AS base, d, ({listed(N.BASE_NEIGHBOURS)})[b * 6 + d] AS nbr FROM range(12) AS x(b), range(1, 7) AS y(d)),
k AS (SELECT * FROM a WHERE d <> CASE WHEN base < 6 THEN 2 ELSE 5 END) SELECT base, CAST(row_number() OVER (PARTITION BY base ORDER BY d) - 1 AS INTEGER) AS k, nbr FROM k""",
    "neighbour_single": f"WITH {EARTH}, {ring_ctes('earth', 'o_orderkey', 6)} SELECT o_orderkey, {signed(packed('b', [f'n{i}' for i in range(1, 7)]))} AS cell, c AS carry FROM r6 WHERE dir = 3",
    "neighbours_exploded": f"WITH {EARTH}, {ring_ctes('earth', 'o_orderkey', 6)} SELECT o_orderkey, dir, nbr FROM ring",
    "neighbours_of_level": f"WITH line AS (SELECT m AS mono, 1 AS one FROM range({12 * 343}) AS t(m) WHERE {valid('m', 3)}), {ring_ctes('line', 'one', 3)} SELECT mono, dir, nbr FROM ring",
    "boundary_accounting": f"""WITH {HOLES}, {ring_ctes('holes', 'event_id', 7)}, j AS (SELECT r.event_id, r.nbr, h.cell FROM ring r LEFT JOIN holes h ON r.nbr = h.cell),
p AS (SELECT event_id, bool_or(nbr IS NULL) AS pent, bool_or(nbr IS NOT NULL AND cell IS NULL) AS outside FROM j GROUP BY event_id)
SELECT count(*) AS cells, count(*) FILTER (pent) AS pentagon, count(*) FILTER (outside) AS out_of_area, count(*) FILTER (outside AND NOT pent) AS boundary_only FROM p""",
    "ring_of_cell": f"""WITH {AOI}, {PIXELS}, asked AS (SELECT DISTINCT mono, {signed(unsigned('mono', 7))} AS cell FROM pixels), {ring_ctes('asked', 'mono', 7)}
SELECT event_id, value FROM aoi WHERE cell IN (SELECT nbr FROM ring WHERE nbr IS NOT NULL UNION SELECT cell FROM asked)""",
    "zonal_mean": f"WITH {PIXELS} SELECT mono, round(CAST(CAST(avg(q) AS FLOAT) AS DOUBLE), 3) AS mean FROM pixels GROUP BY mono",
    "zonal_stats9": f"""WITH {PIXELS}, f AS (SELECT mono, q, count(*) AS n FROM pixels GROUP BY mono, q), m AS (SELECT mono, first(q ORDER BY n DESC, q) AS majority FROM f GROUP BY mono),
s AS (SELECT mono, count(q) AS count, avg(q) AS mean, quantile_cont(q, 0.5) AS median, stddev_pop(q) AS stdev, var_pop(q) AS variance, min(q) AS min, max(q) AS max FROM pixels GROUP BY mono)
SELECT s.mono, count, round(mean, 4) AS mean, round(median, 4) AS median, round(stdev, 4) AS stdev, round(variance, 4) AS variance, round(min, 4) AS min, round(max, 4) AS max,
round(stdev / mean, 4) AS coefficient_of_variation, round(majority, 4) AS majority FROM s JOIN m ON s.mono = m.mono""",
    "parent_rollup": f"""WITH {AOI} SELECT {signed(unsigned('mono // 343', 4))} AS parent, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value FROM aoi GROUP BY mono // 343, parent""",
    "hierarchy_rollup": f"WITH {AOI} " + " UNION ALL ".join(f"SELECT mono // {7 ** (7 - k)} AS mono, count(*) AS n, round(max(value), 6) AS top, {k} AS level FROM aoi GROUP BY mono // {7 ** (7 - k)}" for k in (6, 5, 4)),
    "modal_category": f"WITH {AOI}, f AS (SELECT mono // 49 AS parent, event_type, count(*) AS n FROM aoi GROUP BY ALL) SELECT parent, first(event_type ORDER BY n DESC, event_type) AS modal FROM f GROUP BY parent",
    "value_share": f"WITH {AOI}, f AS (SELECT event_type, count(*) AS n FROM aoi GROUP BY event_type) SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM f",
    "base_cell_breakdown": f"""WITH {EARTH} SELECT CAST(mono // 117649 AS INTEGER) AS base, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least,
round(avg(CAST(o_totalprice > 150000 AS INTEGER)), 6) AS share_large FROM earth GROUP BY 1""",
    "global_stats": f"WITH {AOI} SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, round(stddev_pop(value) / avg(value), 6) AS cv FROM aoi",
    "quantiles": f"WITH {AOI} SELECT " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{k}" for k, q in enumerate((0.5, 0.9, 0.99, 0.995))) + " FROM aoi",
    "histogram": f"WITH {AOI} SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 51 ELSE floor(value / 500 * 50) + 1 END AS BIGINT) AS bin, count(*) AS n FROM aoi WHERE value IS NOT NULL GROUP BY 1",
    "terrain_classes": f"WITH {AOI} SELECT CASE WHEN value / 10 <= 5 THEN 'flat' WHEN value / 10 <= 15 THEN 'gentle' WHEN value / 10 <= 30 THEN 'moderate' ELSE 'steep' END AS terrain, count(*) AS n FROM aoi GROUP BY 1",
    "thresholds": f"WITH {AOI} SELECT count(*) FILTER (value / 500 < 0.95) AS n95, count(*) FILTER (value / 500 < 0.90) AS n90, count(*) FILTER (value / 500 > 0.99) AS n99 FROM aoi",
    "nan_count": f"WITH {AOI} SELECT count(*) AS n, count(*) FILTER (value > 100 OR value <= 10) AS n_nan FROM aoi",
    "uniqueness": f"WITH {AOI} SELECT count(*) AS n, count(DISTINCT mono) AS n_distinct FROM aoi",
    "find_ranges": f'WITH {RANGES} SELECT "start", "end" FROM found',
    "range_offsets": f"WITH {RANGES} SELECT * FROM placed",
    "expand_ranges": f"WITH {HOLES} SELECT mono FROM holes",
    "range_join_positions": f'WITH {RANGES} SELECT event_id, mono, CAST(coalesce("offset" + mono - "start", -1) AS BIGINT) AS position FROM aoi LEFT JOIN placed ON mono BETWEEN "start" AND "end"',
    "slice_ids": f"WITH {HOLES}, p AS (SELECT mono, row_number() OVER (ORDER BY mono) - 1 AS i FROM holes) SELECT mono FROM p WHERE i >= 100 AND i < 1500",
    "range_compression_ratio": f"WITH {RANGES} SELECT count(*) AS r, CAST(sum(n) AS BIGINT) AS n, round(count(*) / sum(n), 9) AS ratio FROM placed",
    "parent_zone_select": f"WITH {AOI} SELECT event_id, value FROM aoi WHERE mono // 343 = {941192 // 343}",
    "select_cells": f"WITH {AOI}, {PIXELS} SELECT event_id, cell FROM aoi WHERE mono IN (SELECT mono FROM pixels)",
    "inner_compare": f"""WITH {AOI}, {PIXELS}, o AS (SELECT mono, avg(q) AS q FROM pixels GROUP BY mono), x AS (SELECT abs(value - q) AS x FROM aoi JOIN o ON aoi.mono = o.mono)
SELECT count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM x""",
    "left_default_lookup": f"""WITH {AOI}, {LOOKUP} SELECT event_id, """ + ", ".join(f"round({BASE!r} * coalesce(d{a} / dg, 1), 6) AS d_{a}" for a in "kji") + " FROM aoi LEFT JOIN lookup ON mono // 343 = m",
    "semi_in_aoi": f"WITH {HOLES}, {ring_ctes('holes', 'event_id', 7)} SELECT r.event_id, count(*) AS n FROM ring r JOIN holes h ON r.nbr = h.cell GROUP BY r.event_id",
    "anti_out_of_aoi": f"WITH {HOLES}, {ring_ctes('holes', 'event_id', 7)} SELECT r.event_id, dir, nbr FROM ring r LEFT JOIN holes h ON r.nbr = h.cell WHERE nbr IS NOT NULL AND h.cell IS NULL",
    "union_levels": f"WITH {AOI} SELECT 7 AS level, mono FROM aoi UNION ALL SELECT DISTINCT 6, mono // 7 FROM aoi",
    "intersect_cells": f"WITH {HOLES}, {PIXELS} SELECT mono FROM holes INTERSECT SELECT mono FROM pixels",
    "bbox_select": f"WITH {LONLAT} SELECT c_custkey, lon, lat FROM lonlat WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN 10 AND 70",
    "chunk_touches": f"""WITH {HOLES}, p AS (SELECT row_number() OVER (ORDER BY mono) - 1 AS i FROM holes) SELECT count(*) AS cells, count(DISTINCT i // 343) AS chunks,
count(DISTINCT i // 343) * 343 AS cells_read FROM p""",
    "layout_roundrobin": f"WITH {HOLES}, p AS (SELECT event_id, row_number() OVER (ORDER BY mono) - 1 AS i FROM holes) SELECT event_id, i AS position, row_number() OVER (ORDER BY i % 7, i) - 1 AS moved FROM p",
    "slope_isotropic": f"WITH {GATHER} SELECT holes.event_id, round({slope(repr(BASE), repr(BASE), repr(BASE))}, 9) AS slope FROM holes LEFT JOIN six ON holes.event_id = six.event_id",
    "slope_lookup": f"""WITH {GATHER}, {LOOKUP}, w AS (SELECT event_id, """ + ", ".join(f"{BASE!r} * coalesce(d{a} / dg, 1) AS w{a}" for a in "kji") + f""" FROM holes LEFT JOIN lookup ON mono // 343 = m)
SELECT w.event_id, round({slope('wk', 'wj', 'wi')}, 9) AS slope FROM w LEFT JOIN six ON w.event_id = six.event_id""",
    "slope_degrees_stats": f"""WITH {GATHER}, x AS (SELECT degrees(atan({slope(repr(BASE), repr(BASE), repr(BASE))})) AS x FROM holes LEFT JOIN six ON holes.event_id = six.event_id)
SELECT count(*) AS n, count(x) AS n_known, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.9), 6) AS p90 FROM x""",
    "neighbour_spread": f"""WITH {AOI}, {ring_ctes('aoi', 'event_id', 7)}, far AS (SELECT event_id, max(abs(nb * 823543 + n1 * 117649 + n2 * 16807 + n3 * 2401 + n4 * 343 + n5 * 49 + n6 * 7 + n7 * 1 - mono)) AS s FROM x9 GROUP BY event_id)
SELECT CAST(max(s) AS BIGINT) AS most, CAST(min(s) AS BIGINT) AS least, round(avg(s), 4) AS mean FROM far""",
    "dominant_axis": f"""WITH {AXES}, {RANK_DOWN}, {WIDE} SELECT s_suppkey, CASE WHEN m1 / ((m2 + m3) / 2) >= 1.05 AND m1 > m2 + 0.5 * sqrt(s1 * s1 + s2 * s2) THEN axis1 END AS axis, round(m1 / ((m2 + m3) / 2), 9) AS ratio FROM wide""",
    "dominant_axis_twosided": f"""WITH {AXES}, {RANK_UP}, {WIDE}, t AS (SELECT *, m3 / m2 >= 1.02 AND m3 - m2 >= 0.5 * sqrt(s3 * s3 + s2 * s2) AS high, m2 / m1 >= 1.02 AND m2 - m1 >= 0.5 * sqrt(s2 * s2 + s1 * s1) AS low FROM wide)
SELECT s_suppkey, CASE WHEN high THEN axis3 WHEN low THEN axis1 END AS axis, CASE WHEN high THEN 'high' WHEN low THEN 'low' END AS side FROM t""",
    "anisotropy_metrics": """WITH t AS (SELECT p_partkey, p_retailprice + p_partkey * 2 % 9 AS k, p_retailprice + p_partkey * 5 % 9 AS j, p_retailprice + p_partkey * 7 % 9 AS i FROM part)
SELECT p_partkey, round(cbrt(k * j * i), 6) AS geom, round((k + j + i) / 3, 6) AS arith, round(least(k, j, i) / greatest(k, j, i), 9) AS squeeze,
CASE WHEN k = least(k, j, i) THEN 'k' WHEN j = least(k, j, i) THEN 'j' ELSE 'i' END AS squeezed_axis, round(greatest(k, j, i), 6) AS most FROM t""",
    "lsq_plane": """WITH t AS (SELECT l_suppkey, l_quantity - 25 AS e, CAST(l_linenumber - 3 AS DOUBLE) AS n, l_extendedprice AS h FROM lineitem),
s AS (SELECT l_suppkey, sum(e * e) AS ee, sum(e * n) AS en, sum(n * n) AS nn, sum(e * h) AS eh, sum(n * h) AS nh FROM t GROUP BY l_suppkey),
f AS (SELECT l_suppkey, (eh * nn - nh * en) / (ee * nn - en * en) AS a, (nh * ee - eh * en) / (ee * nn - en * en) AS b FROM s WHERE ee * nn - en * en <> 0)
SELECT l_suppkey, round(a, 4) AS a, round(b, 4) AS b, round(sqrt(a * a + b * b), 4) AS slope FROM f""",
    "archive_round_trip": f"WITH {HOLES} SELECT cell, mono, event_id, value FROM holes",
    "archive_dense": f"WITH {HOLES} SELECT cell, mono, event_id, value FROM holes",
    "archive_append": f"WITH {AOI} SELECT cell, mono, event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM aoi",
    "archive_metadata": "SELECT 'igeo7' AS name, 7 AS level, 'ranges' AS compression, 'alternating_cw_odd_ccw_even' AS rotation, 7 AS coordinate_level, 11.2::DOUBLE AS vertex",
    **{f"sink_{k}": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type" for k in ("parquet", "csv", "json")},
    "regrid_pipeline": f"""WITH {PIXELS}, m AS (SELECT mono, avg(q) AS mean FROM pixels WHERE q <> 50 GROUP BY mono) SELECT {signed(unsigned('mono', 7))} AS cell, round(CAST(CAST(mean AS FLOAT) AS DOUBLE), 3) AS mean FROM m""",
    "geodesic_distance": f"""WITH {LONLAT}, far AS (SELECT c_custkey, lon AS x1, lat AS y1, lon + 0.1::DOUBLE AS x2, lat / 2 AS y2 FROM lonlat), {geodesic_ctes('far', 'c_custkey')}
SELECT c_custkey, round(distance, 3) AS distance, round(azimuth, 6) AS azimuth FROM geo""",
    "direction_geodesics": f"WITH {DIRECTED} SELECT cell, dir, nbr, round(distance, 2) AS distance, round(z, 2) AS bearing FROM geo",
    "slope_geodesic": f"""WITH {DIRECTED}, {ENDS}, {HEIGHTS} SELECT event_id, round(CASE WHEN n = 6 AND value IS NOT NULL THEN sqrt(pow((h1 - h6) / (e1 + e6), 2)
+ pow((h4 + h5 - h2 - h3) / (sqrt(3) * ((e2 + e5) / 2 + (e4 + e3) / 2)), 2)) END, 6) AS slope FROM holes LEFT JOIN ends ON holes.cell = ends.cell LEFT JOIN wide6 ON holes.cell = wide6.cell""",
    "slope_variants": f"""WITH {DIRECTED}, {ENDS}, {HEIGHTS}, offset6 AS (SELECT cell, sum(pow(e, 2)) AS ee, sum(n * n) AS nn, sum(e * n) AS en, sum(e * r) AS eh, sum(n * r) AS nh FROM
(SELECT g.cell, g.distance * sin(radians(g.z)) AS e, g.distance * cos(radians(g.z)) AS n, h.value - o.value AS r FROM geo g JOIN holes h ON g.nbr = h.cell JOIN holes o ON g.cell = o.cell) GROUP BY cell)
SELECT w.cell, round(sqrt(pow((h1 - h4) / (2 * {stats.cls_m(7)!r}), 2) + pow((h2 + h3 - h5 - h6) / (2 * sqrt(3) * {stats.cls_m(7)!r}), 2)), 6) AS paper,
round(sqrt(pow((h1 - h6) / (2 * {stats.cls_m(7)!r}), 2) + pow((h4 + h5 - h2 - h3) / (2 * sqrt(3) * {stats.cls_m(7)!r}), 2)), 6) AS axes,
round(sqrt(pow((h1 - h6) / (e1 + e6), 2) + pow((h4 + h5 - h2 - h3) / (2 * sqrt(3) * (e2 + e3 + e4 + e5) / 4), 2)), 6) AS geodesic,
round(CASE WHEN ee * nn - en * en <> 0 THEN sqrt(pow((eh * nn - nh * en) / (ee * nn - en * en), 2) + pow((nh * ee - eh * en) / (ee * nn - en * en), 2)) END, 3) AS plane
FROM wide6 w JOIN ends ON w.cell = ends.cell JOIN offset6 ON w.cell = offset6.cell WHERE n = 6""",
    "axis_sweep": f"WITH {SWEEP} SELECT cell, round(geom, 2) AS geom, round(squeeze, 6) AS squeeze, axis AS squeezed_axis FROM swept",
    "axis_sweep_by_parent": f"""WITH {BY_PARENT} SELECT parent, n, round(mean_d_k, 2) AS mean_d_k, round(std_d_k, 2) AS std_d_k, round(mean_d_j, 2) AS mean_d_j, round(mean_d_i, 2) AS mean_d_i,
round(mean_d_geom, 2) AS mean_d_geom, round(mean_squeeze, 6) AS mean_squeeze, round(min_squeeze, 6) AS min_squeeze, modal_squeezed_axis FROM by_parent""",
    "lookup_table_sink": f"WITH {BY_PARENT} SELECT parent, " + ", ".join(f"round(mean_d_{a} / mean_d_geom, 6) AS w_{a}" for a in "kji") + " FROM by_parent",
    "synthetic_surfaces": f"""WITH {AOI}, {PLACES}, {XY} SELECT event_id, round(x * 0.05::DOUBLE + y * 0.03::DOUBLE, 4) AS plane, round({FLAT}, 4) AS plane_slope,
round((x * x + y * y) * 1e-6, 4) AS bowl, round(sqrt(x * x + y * y) * 2e-6, 4) AS bowl_slope FROM xy""",
    "relative_errors": f"""WITH {AOI}, {PLACES}, {XY}, heights AS (SELECT event_id, mono, cell, x * 0.05::DOUBLE + y * 0.03::DOUBLE AS h FROM xy), {ring_ctes('heights', 'event_id', 7)},
six AS (SELECT r.event_id, count(*) AS n, {", ".join(f"max(CASE WHEN r.dir = {k} THEN o.h END) AS h{k}" for k in range(1, 7))} FROM ring r JOIN heights o ON r.nbr = o.cell GROUP BY r.event_id),
e AS (SELECT ({slope(repr(BASE), repr(BASE), repr(BASE))} - {FLAT}) / {FLAT} * 100 AS error FROM six)
SELECT count(error) AS n, round(avg(error), 4) AS mean, round(max(error), 4) AS most FROM e""",
    "parity_check": """WITH g AS (SELECT avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 END) AS e, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 1000 END) AS o FROM orders)
SELECT round(e, 6) AS even, round(o, 6) AS odd, round(abs(e - o), 6) AS gap, abs(e - o) <= 0.5 AS within FROM g""",
    "distance_ratio": "SELECT p_partkey, round(greatest(p_retailprice * 60, 62161.7764) / least(p_retailprice * 60, 62161.7764), 9) AS ratio FROM part",
    "nodata_to_missing": f"WITH {PIXELS} SELECT count(*) AS n, count(*) FILTER (q <> 50) AS known, round(avg(q) FILTER (q <> 50), 6) AS mean FROM pixels",
    "hex_cells_only": f"WITH c AS (SELECT m AS mono FROM range({12 * 7**4}) AS t(m) WHERE {valid('m', 4)} AND m % 2401 <> 0) SELECT mono, {signed(unsigned('mono', 4))} AS cell FROM c",
    "cells_by_list_and_prefix": f"WITH {EARTH} SELECT o_orderkey, {TEXT} AS text FROM earth WHERE mono // 117649 IN (3, 5, 7)",
    "nearest_centroid": f"""WITH {AOI}, {PLACES} SELECT event_id, lon, lat FROM places ORDER BY pow(sin(radians(lat - 58.7654) / 2), 2) + cos(radians(lat)) * cos(radians(58.7654)) * pow(sin(radians(lon - 25.1234) / 2), 2), event_id LIMIT 1""",
    "rows_at_positions": f"WITH {HOLES}, p AS (SELECT event_id, mono, row_number() OVER (ORDER BY mono) - 1 AS i FROM holes) SELECT event_id, mono FROM p WHERE i >= 200 AND i < 700",
    "halo_amplification": f"""WITH {HOLES}, {ring_ctes('holes', 'cell', 7)}, p AS (SELECT cell, (row_number() OVER (ORDER BY mono) - 1) // 343 AS c FROM holes),
j AS (SELECT a.c AS a, b.c AS b FROM ring r JOIN p a ON r.cell = a.cell JOIN p b ON r.nbr = b.cell WHERE a.c <> b.c), k AS (SELECT (SELECT max(c) + 1 FROM p) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM j)) AS f, (SELECT count(*) FROM j) AS halo)
SELECT chunks, chunks + f AS touches, round((chunks + f) / chunks, 9) AS amplification, f AS foreign, halo FROM k""",
    "find_distinct_ranges": f"""WITH {PIXELS}, one AS (SELECT DISTINCT mono FROM pixels), g AS (SELECT mono, mono - row_number() OVER (ORDER BY mono) AS i FROM one) SELECT min(mono) AS "start", max(mono) AS "end" FROM g GROUP BY i""",
    "cells_with_parent_summary": f"""WITH {HOLES}, s AS (SELECT mono // 49 AS m, count(*) AS n, avg(value) AS v FROM holes GROUP BY 1 HAVING count(*) > 40)
SELECT event_id, n, round(v, 6) AS mean_value FROM aoi LEFT JOIN s ON aoi.mono // 49 = s.m""",
    "reindex_to_order": f"WITH {HOLES}, {PIXELS}, o AS (SELECT DISTINCT mono, mono * 31 % 101 AS place FROM pixels) SELECT o.mono, place, event_id FROM o LEFT JOIN holes ON o.mono = holes.mono",
    "distinct_pairs": "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)",
    "median_of_repeats": "SELECT l_returnflag, l_linestatus, l_linenumber, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY ALL",
    "describe_values": "SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events",
    "children_listed": f"WITH {EARTH} SELECT mono // 7 AS parent, string_agg(CAST(mono AS VARCHAR), ',' ORDER BY mono) AS children FROM earth GROUP BY 1",
    "raw_id_gaps": f"WITH {HOLES} SELECT cell, cell - lag(cell) OVER (ORDER BY mono) AS gap FROM holes",
    "set_differences": f"WITH {HOLES}, c AS (SELECT DISTINCT mono // 7 * 7 + k AS mono FROM holes, range(7) AS t(k)) SELECT mono FROM c WHERE mono NOT IN (SELECT mono FROM holes)",
    "terrain_shares": f"WITH {AOI}, t AS (SELECT CASE WHEN value / 10 <= 5 THEN 'flat' WHEN value / 10 <= 15 THEN 'gentle' WHEN value / 10 <= 30 THEN 'moderate' ELSE 'steep' END AS terrain FROM aoi) SELECT terrain, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM t GROUP BY terrain",
    "k_ring": rings(3),
    "find_resolution_other_metrics": f"""WITH {STATS}, target AS (SELECT c_custkey, abs(c_acctbal) + 1 AS t FROM customer)
SELECT c_custkey, (SELECT resolution FROM stats WHERE area_m2 >= t ORDER BY abs(area_m2 - t), resolution LIMIT 1) AS by_area,
(SELECT resolution FROM stats ORDER BY abs(num_cells - CAST(floor(t) AS BIGINT) * 100), resolution LIMIT 1) AS by_count FROM target""",
    "neighbour_positions": f"""WITH {HOLES}, {ring_ctes('holes', 'event_id', 7)}, p AS (SELECT event_id, cell, row_number() OVER (ORDER BY mono) - 1 AS i FROM holes),
far AS (SELECT a.event_id, max(abs(a.i - b.i)) AS s FROM ring r JOIN p a ON r.event_id = a.event_id JOIN p b ON r.nbr = b.cell GROUP BY a.event_id)
SELECT max(s) AS most, (SELECT event_id FROM far ORDER BY s DESC, event_id LIMIT 1) AS where_most, min(s) AS least FROM far""",
}
