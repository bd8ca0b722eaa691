"""Every registered query against its SQL counterpart, on the smallest tables."""

import datetime as dt
import glob
import math
import os

import pytest

import __spark_entry__ as entry_points
from tickloom.plans.catalog import QUERIES
from tickloom.plans.oracles import oracles

DATA = "/root/testdata/sf0.001"
ORACLES = oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_names():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "train_linear", "train_boosted", "train_stacking", "train_forest", "isolation_forest",
        "job_weekly_train"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    frame = entry_points.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in places) for row in result.fetchall()]
    assert len(want) > 0
    assert ordered(got) == ordered(want)


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 25
