"""Every query with SQL equals that SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lakeloom import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    got = core.queries()[name](spark, DATA)
    cursor = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda found, own: sorted([shown(r[own.index(c)]) for c in order] for r in found)
    assert rows(got.collect(), got.columns) == rows(cursor.fetchall(), names)
