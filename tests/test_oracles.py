"""Every library query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strandwise.plans import every

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(every.QUERIES))
def test_query(spark, duck, name):
    df = every.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(map(_plain, r)) for r in df.select(*cols).collect()]
    if name not in every.ORACLES:
        assert rows
        return
    r = duck.execute(every.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(_plain(row[names.index(c)]) for c in cols) for row in r.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)
