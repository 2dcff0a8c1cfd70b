"""Every query of the reference's own operators against DuckDB on whole tables."""

import os

import duckdb
import pytest

from cadenza.plans import details, exchange, records, streams, timeline  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows):
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([tuple(value(v) for v in r) for r in rows], key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = plain([r[names.index(c)] for c in cols] for r in found.fetchall())
    got = plain(df.select(*cols).collect())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
