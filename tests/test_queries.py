"""Every registered toolkit query beside its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import queries as toolkit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(toolkit.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = toolkit.queries()[name](spark, SF)
    got = con.execute(toolkit.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(plain(x) for x in row) for row in got.fetchall())
    assert sorted(tuple(plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(toolkit.queries()) - set(toolkit.oracle_sql()) - {"matrix_conjugate_gradient"}))
def test_runs(spark, name):
    assert toolkit.queries()[name](spark, SF).count() > 0
