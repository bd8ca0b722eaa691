"""The registered queries of the training-data operators against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tickloom.llm.queries import QUERIES, oracles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return list(value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(
            f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = connection.execute(oracles()[name])
    names = [d[0] for d in result.description]
    want = [tuple(map(plain, row)) for row in result.fetchall()]
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(names)
    got = [tuple(plain(row[c]) for c in names) for row in frame.collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(oracles()) <= set(QUERIES)
