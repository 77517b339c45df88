"""Every registered query of the library against its SQL twin."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerline.plans import registry

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not SMALL.exists():
        pytest.skip("needs the small tables")
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SMALL))
    got = [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = [{k: plain(v) for k, v in zip(names, r, strict=True)} for r in cur.fetchall()]
    assert set(names) == set(df.columns)
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)
