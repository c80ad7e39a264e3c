"""Every query against its SQL, over the smallest tables: same columns, same rows whatever their order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from stationlens.plans import catalog, service  # noqa: F401  service adds to the catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(canonical(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(canonical(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
