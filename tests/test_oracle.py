"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from codeloom import plans

FOLDER = os.environ.get("CODELOOM_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([str(plain(r[i])) for i in order] for r in values)), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, tables, name):
    frame = plans.QUERIES[name](spark, FOLDER)
    found = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = tables.execute(plans.ORACLE[name])
    assert found == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() >= 0
