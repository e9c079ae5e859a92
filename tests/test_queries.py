"""Every query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarrymill.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    answer = tables.execute(catalog.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((plain(r) for r in answer.fetchall()), key=str)
    assert sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=str) == want
