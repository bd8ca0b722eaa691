import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators.cleaning import clean_stock_data, cleaning_report, dedup_dates, load_casts
from tickloom.operators.quality import (
    FEED, date_gaps, quality_gate, validate_quality,
)
from tickloom.operators.series import Series

FEED_SCHEMA = ("seq bigint, symbol string, date string, open string, high string, low string, "
               "close string, volume string")
FEED_ROWS = [
    (1, "A", "2024-01-02", "1", "2", "0.5", "1.5", "10"),
    (2, "A", "2024-01-02", "9", "9", "9", "9", "9"),
    (3, "A", "2024-01-03", "1", "2", "0.5", None, "10"),
    (4, "A", "2024-01-03", "2", "3", "1.5", "2.5", "20"),
    (5, "A", "2024-01-04", "abc", "3", "1.5", "2.5", "30"),
    (6, "A", "2024-01-01", "1", "2", "0.5", "1.5", "0"),
]
BARS = ("seq bigint, symbol string, date date, open double, high double, low double, "
        "close double, volume bigint")


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(FEED_ROWS, FEED_SCHEMA).repartition(3)


def bars_on(spark, symbol, days, **values):
    defaults = dict(open=1.0, high=2.0, low=0.5, close=1.5, volume=10) | values
    return spark.createDataFrame(
        [(i, symbol, d, *defaults.values()) for i, d in enumerate(days)], BARS)


def test_cleaning_keeps_the_first_complete_row_of_a_day(feed):
    rows = clean_stock_data(feed).orderBy("date").collect()
    assert [(r.date.day, r.seq) for r in rows] == [(1, 6), (2, 1), (3, 4), (4, 5)]
    assert rows[3].open is None and rows[3].close == 2.5
    assert cleaning_report(feed).collect()[0].asDict() == {
        "symbol": "A", "initial_rows": 6, "kept_rows": 4, "dropped_rows": 2}


def test_fractions_of_volume_are_cut_off_and_unparsable_values_become_null(spark):
    feed = spark.createDataFrame(
        [(1, "A", "2024-01-02", "1", "2", "1", "x", "2.5"),
         (2, "A", "not a day", "1", "2", "1", "1", "2"),
         (3, "A", "2024-01-03 09:30:00", "1", "2", "1", "NaN", "3.0")], FEED_SCHEMA)
    rows = clean_stock_data(feed).orderBy("date").collect()
    assert [(r.close, r.volume) for r in rows] == [(None, 2), (None, 3)]
    assert [r.volume for r in load_casts(clean_stock_data(feed)).orderBy("date").collect()] == [
        2, 3]


def test_many_copies_of_one_day(spark):
    copies = spark.range(20_000).select(
        F.col("id").alias("seq"), F.lit("A").alias("symbol"),
        F.lit(dt.date(2024, 1, 2)).alias("date"), (F.col("id") * 1.0).alias("close"))
    assert [tuple(r) for r in dedup_dates(copies).collect()] == [
        ("A", dt.date(2024, 1, 2), 0, 0.0)]


def test_report_of_the_cleaned_feed(feed):
    report = validate_quality(clean_stock_data(feed)).collect()[0]
    assert not report.passed
    assert report.issues == ["Null values found: {'open': 1}", "1 rows with zero volume"]


@pytest.mark.parametrize("span", (1, 4, 1000))
def test_gaps_are_found_across_blocks(spark, span):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2024, 1, 8)]
    bars = bars_on(spark, "A", days)
    got = date_gaps(bars, Series("symbol", "date", span)).collect()[0]
    assert (got.gaps, got.max_gap) == (1, 6)
    issues = validate_quality(bars).collect()[0].issues
    assert issues == ["1 date gaps > 5 days found (max gap: 6.0 days)"]


def test_empty_instruments_are_reported(spark):
    universe = spark.createDataFrame([("A",), ("B",)], "symbol string")
    bars = bars_on(spark, "A", [dt.date(2024, 1, 1)])
    report = {r.symbol: (r.passed, r.issues)
              for r in validate_quality(bars, universe).collect()}
    assert report == {"A": (True, []), "B": (False, ["DataFrame is empty"])}


def test_issue_order(spark):
    bars = bars_on(spark, "A", [dt.date(2024, 1, 1)], open=-1.0, high=0.0, low=3.0, volume=0)
    assert validate_quality(bars).collect()[0].issues == [
        "1 rows with zero volume", "1 rows with non-positive open",
        "1 rows with non-positive high", "1 rows where high < low"]


def test_gate_policies(spark):
    day = [dt.date(2024, 1, 1)]
    bars = bars_on(spark, "A", day).unionByName(bars_on(spark, "B", day, volume=0))
    report = validate_quality(bars)
    assert quality_gate(bars, report).count() == 2
    assert [r.symbol for r in quality_gate(bars, report, "drop_symbol").collect()] == ["A"]
    with pytest.raises(ValueError):
        quality_gate(bars, report, "raise")
    with pytest.raises(ValueError):
        quality_gate(bars, report, "ignore")
    assert FEED.key == "symbol"
