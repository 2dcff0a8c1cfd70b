"""Every training-data query that SQL can express against DuckDB on whole tables."""

import os

import duckdb
import pytest

from cadenza.llm.oracles import ORACLES
from cadenza.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Rows as texts, as columns may hold nulls, with all numbers alike."""
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([value(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = plain([r[names.index(c)] for c in cols] for r in found.fetchall())
    got = plain(df.select(*cols).collect())
    assert got == want and got
