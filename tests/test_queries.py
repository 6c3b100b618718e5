"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from colloquy.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    result = con.sql(ORACLE_SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert got == plain(tuple(r[i] for i in at) for r in result.fetchall())
