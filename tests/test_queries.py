"""Every query against its SQL, as the driver compares them."""

import math

import duckdb
import pytest

from heptagrid.plans.oracle import ORACLES
from heptagrid.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    norm = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(norm(r[k]) for k in at) for r in found), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, map(tuple, df.collect()))
    assert got
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows(columns, cur.fetchall())
        assert got == want


def test_chunk_touches_of_all_rows(spark, sf, con):
    cells = con.execute("SELECT count(*) FROM events WHERE event_type <> 'error'").fetchone()[0]
    assert tuple(QUERIES["chunk_touches"](spark, sf).first()) == (cells, -(-cells // 343), -(-cells // 343) * 343)


def test_select_cells_asks_for_repeated_and_missing_cells(spark, sf, con):
    asked = [r[0] for r in con.execute("SELECT l_orderkey % 16807 FROM lineitem").fetchall()]
    there = {r[0] for r in con.execute("SELECT event_id FROM events").fetchall()}
    assert len(set(asked)) < len(asked) and set(asked) - there and there - set(asked)
    got = [r.event_id for r in QUERIES["select_cells"](spark, sf).collect()]
    assert sorted(got) == sorted(there & set(asked))


def test_neighbours_of_every_cell(spark, sf):
    rows = QUERIES["neighbours_of_level"](spark, sf).collect()
    assert {r.mono // 343 for r in rows if r.mono % 343 >= 60} == set(range(12))
    assert len({r.mono for r in rows}) == 10 * 7**3 + 2 and len(rows) == 6 * (10 * 7**3 + 2)
    assert sum(r.nbr is None for r in rows) == 12


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
