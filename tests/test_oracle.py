"""Every query against its own SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronofold import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
RUNS = catalog.queries()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in SQL if n not in catalog.SHARED])
def test_same_rows(spark, duck, name):
    df = RUNS[name](spark, SF)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=repr)
    r = duck.execute(SQL[name])
    columns = [c[0] for c in r.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(df.columns)
    want = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n in RUNS if n not in SQL and n not in catalog.SHARED])
def test_runs(spark, name):
    """Queries without SQL give rows, none of them empty throughout; their values are tested elsewhere."""
    df = RUNS[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
