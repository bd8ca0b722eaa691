import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import (
    BAR_SCHEMA, START, assert_same, pandas_features, pandas_flow, random_bars, to_pandas_bars,
)
from tickloom.operators.capital_flow import compute_capital_flow
from tickloom.operators.features import (
    compute_features, compute_features_for_stock, refreshed_features,
)
from tickloom.operators.series import Series
from tickloom.operators.training import fold_of, with_next_close

# Spans from one-day blocks, where most blocks are empty, to a single block.
SPANS = (1, 5, 40, 100_000)


@pytest.mark.parametrize("span", SPANS)
def test_features_do_not_depend_on_block_length(spark, span):
    rows = random_bars(1, (120, 45, 2, 1, 31), null_share=0.1)
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    got = compute_features(bars, Series(span_days=span))
    assert_same(got, pandas_features(to_pandas_bars(rows)))


@pytest.mark.parametrize("span", SPANS)
def test_capital_flow_does_not_depend_on_block_length(spark, span):
    rows = random_bars(2, (90, 15, 14, 40))
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    got = compute_capital_flow(bars, Series(span_days=span))
    assert_same(got, pandas_flow(to_pandas_bars(rows)))


def test_long_runs_of_missing_closes_are_bridged(spark):
    rows = [list(r) for r in random_bars(3, (120,), gap=1)]
    for row in rows[10:100]:
        row[5] = None
    bars = spark.createDataFrame([tuple(r) for r in rows], BAR_SCHEMA)
    got = compute_features(bars, Series(span_days=16))
    assert_same(got, pandas_features(to_pandas_bars(rows)))


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = random_bars(4, (70, 20))
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    shuffled = bars.orderBy(F.rand(5)).repartition(7)
    assert_same(compute_features(shuffled, Series(span_days=20)),
                compute_features(bars).toPandas())


def test_one_instrument_with_most_rows(spark):
    rows = random_bars(5, (900, 3, 2, 2), gap=1)
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    blocked = Series(span_days=64).blocked(bars)
    largest = blocked.groupBy("stock_id", "_block").count().agg(F.max("count")).first()[0]
    assert largest <= 64
    assert_same(compute_features(bars, Series(span_days=64)),
                pandas_features(to_pandas_bars(rows)))


def test_returns_and_averages_by_hand(spark):
    rows = [(1, START + dt.timedelta(days=i), 1.0, 2.0, 1.0, c, 5)
            for i, c in enumerate((10.0, 10.5, 9.75))]
    got = compute_features(spark.createDataFrame(rows, BAR_SCHEMA)).orderBy("trade_date").collect()
    assert [r.daily_return for r in got] == [
        None, pytest.approx(0.05), pytest.approx(-0.0714286, abs=1e-7)]
    for average in ("ma_7", "ma_30"):
        assert [r[average] for r in got] == [
            10.0, 10.25, pytest.approx(10.0833333, abs=1e-7)]


def test_missing_close_repeats_the_last_one(spark):
    rows = [(1, START + dt.timedelta(days=i), 1.0, 2.0, 1.0, c, 5)
            for i, c in enumerate((10.0, None, 11.0, 12.0))]
    got = compute_features(spark.createDataFrame(rows, BAR_SCHEMA)).orderBy("trade_date").collect()
    assert [r.daily_return for r in got] == [
        None, 0.0, pytest.approx(0.1), pytest.approx(0.0909091, abs=1e-7)]


def test_zero_open_gives_no_ratio_and_single_bars_no_features(spark):
    day = dt.timedelta(days=1)
    rows = [(1, START, 0.0, 2.0, 1.0, 1.5, 5), (1, START + day, 1.0, 2.0, 1.0, 1.5, 5),
            (2, START, 1.0, 2.0, 1.0, 1.5, 5)]
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    first = compute_features(bars).where(F.col("trade_date") == F.lit(START)).collect()
    assert [(r.stock_id, r.volatility, r.capital_flow_indicator) for r in first] == [
        (1, None, None)]
    prices = bars.select("stock_id", "trade_date", "volume", *[
        F.col(c).alias(f"{c}_price") for c in ("open", "high", "low", "close")])
    assert compute_features_for_stock(prices, 1).count() == 2
    assert compute_features_for_stock(prices, 2).count() == 0


def test_money_flow_index_by_hand(spark):
    # Flows by day: none, in 5, out 3, none; then eleven flat days.
    typical = [1.0, 2.0, 1.0, 1.0] + [1.0] * 11
    money = [1.0, 5.0, 3.0, 1.0] + [1.0] * 11
    rows = [(1, START + dt.timedelta(days=i), t, t, t, t, int(m / t * 2))
            for i, (t, m) in enumerate(zip(typical, money))]
    got = compute_capital_flow(
        spark.createDataFrame(rows, BAR_SCHEMA), Series(span_days=3)).orderBy("trade_date")
    values = [r.mfi_14 for r in got.collect()]
    assert len(values) == 15
    assert values[:2] == [None, None]
    assert values[2:4] == [pytest.approx(62.5), pytest.approx(62.5)]
    assert compute_capital_flow(spark.createDataFrame(rows[:14], BAR_SCHEMA)).count() == 0


@pytest.mark.parametrize("since", (START, START + dt.timedelta(days=60), dt.date(2030, 1, 1)))
def test_refreshed_features_equal_a_full_run(spark, since):
    rows = [list(r) for r in random_bars(6, (120, 10, 1, 40), null_share=0.1)]
    for row in rows[5:45]:
        row[5] = None
    bars = spark.createDataFrame([tuple(r) for r in rows], BAR_SCHEMA)
    full = compute_features(bars).where(F.col("trade_date") >= F.lit(since)).toPandas()
    assert_same(refreshed_features(bars, since, Series(span_days=30)), full)


def test_a_second_bar_also_gives_the_first_its_features(spark):
    rows = random_bars(8, (60, 60), gap=1)
    rows = rows[30:32] + rows[60:]
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    second = max(r[1] for r in rows if r[0] == 1)
    got = refreshed_features(bars, second).where("stock_id = 1").count()
    assert got == 2
    assert refreshed_features(bars, second).where("stock_id = 2").count() == sum(
        r[0] == 2 and r[1] >= second for r in rows)


@pytest.mark.parametrize("span", SPANS)
def test_next_close_and_positions(spark, span):
    rows = random_bars(7, (30, 3, 1), null_share=0.2)
    joined = spark.createDataFrame(rows, BAR_SCHEMA).withColumnRenamed("close", "close_price")
    series = Series(span_days=span)
    frame = to_pandas_bars(rows)
    groups = frame.groupby("stock_id")
    expected = frame[["stock_id", "trade_date"]].assign(
        target=groups["close"].shift(-1), position=groups.cumcount() + 1,
        total=groups["close"].transform("size"))
    got = series.positions(with_next_close(joined, series))
    assert_same(got, expected)


@pytest.mark.parametrize("rows, sizes", ((7, [2, 2, 1, 1, 1]), (10, [2] * 5), (3, [1, 1, 1])))
def test_folds_are_contiguous(spark, rows, sizes):
    frame = spark.range(1, rows + 1).select(F.col("id").alias("position"))
    folds = [r[0] for r in frame.select(
        fold_of("position", F.lit(rows))).orderBy("position").collect()]
    assert folds == sorted(folds)
    assert pd.Series(folds).value_counts().sort_index().tolist() == sizes
