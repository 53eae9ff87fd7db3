"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from foldspark.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return value.normalize() + 0
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    frame = registry.QUERIES[name](spark, DATA)
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, want.fetchall())
