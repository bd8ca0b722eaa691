import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from helpers import BAR_SCHEMA, START, assert_same, pandas_features, random_bars, to_pandas_bars
from tickloom.operators.features import compute_features
from tickloom.operators.series import Series
from tickloom.plans import jobs
from tickloom.plans.catalog import candle_payloads
from tickloom.plans.mapping import bar_aggregates
from tickloom.operators.cleaning import clean_stock_data
from tickloom.sources.payloads import parse_candles
from tickloom.session import scratch_path, sized_for
from tickloom.sinks.tables import read_table
from tickloom.streaming import bars as stream

AT = dt.datetime(2024, 1, 1)
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@pytest.fixture(scope="module")
def market(spark):
    """A market of two instruments and the rows it was made of."""
    rows = random_bars(31, (100, 70))
    names = {1: "AAA", 2: "BBB"}
    bars = spark.createDataFrame(
        [(names[r[0]], *r[1:]) for r in rows],
        T.StructType([T.StructField("symbol", T.StringType()), *BAR_SCHEMA.fields[1:]]))
    universe = spark.createDataFrame(
        [(n, n) for n in names.values()], "symbol string, company_name string")
    return rows, bars, universe


def test_jobs(spark, market):
    rows, bars, universe = market
    store = jobs.Store(scratch_path(spark, "store"))
    last = max(r[1] for r in rows if r[0] == 1)
    early = bars.where(F.col("trade_date") < F.lit(last))
    jobs.backfill(spark, store, candle_payloads(early), universe, loaded_at=AT)
    # A second run changes nothing.
    features = jobs.backfill(spark, store, candle_payloads(early), universe, loaded_at=AT)
    expected = [r for r in rows if r[1] < last]
    assert_same(features, pandas_features(to_pandas_bars(expected)))
    assert store.read(spark, "stocks").count() == 2

    report, best = jobs.weekly_training(spark, store, ("linear_regression",))
    assert {r.status for r in report.collect()} == {"trained"}
    assert [r.best_model for r in best.collect()] == ["linear_regression"] * 2

    feed = bars.where(F.col("trade_date") >= F.lit(last)).select(
        F.lit(0).cast("bigint").alias("seq"), "symbol", F.col("trade_date").alias("date"),
        "open", "high", "low", "close", "volume")
    predictions, anomalies = jobs.daily_update(
        spark, store, feed, last, ("linear_regression", "xgboost"), trees=10, loaded_at=AT)
    assert_same(store.read(spark, "features"), pandas_features(to_pandas_bars(
        [r for r in rows if r[0] == 1 or r[1] <= last])))
    assert predictions.groupBy("model_name").count().collect()[0]["count"] == 16
    assert anomalies.where("anomaly_flag").count() > 0


def test_policy_and_window(spark, market):
    rows, bars, universe = market
    store = jobs.Store(scratch_path(spark, "store"))
    with pytest.raises(ValueError):
        broken = bars.withColumn("volume", F.lit(0).cast("bigint"))
        jobs.backfill(spark, store, candle_payloads(broken), universe, on_fail="raise")
    as_of = START + dt.timedelta(days=365 + 20)
    jobs.backfill(spark, store, candle_payloads(bars), universe, as_of=as_of, loaded_at=AT)
    first = store.read(spark, "prices").agg(F.min("trade_date")).first()[0]
    assert first >= as_of - dt.timedelta(days=365)


def ticks(spark, days):
    rows = [(d * 100 + i, dt.datetime(2024, 1, 1 + d, i), name, float((d * 7 + i * 3) % 11))
            for d in days for i in range(20) for name in ("x", "y")]
    return spark.createDataFrame(rows, EVENTS)


def test_daily_batches_equal_one_batch(spark):
    folder, path, checkpoint = (scratch_path(spark, n) for n in ("ticks", "bars", "offsets"))
    for days in ((0, 1), (1, 2), (3,)):
        part = ticks(spark, days)
        if days == (1, 2):
            # The second half of a day already seen arrives late, within the allowed lateness.
            part = part.where("hour(ts) >= 10 or dayofmonth(ts) = 3")
        if days == (0, 1):
            part = part.where("hour(ts) < 10 or dayofmonth(ts) = 1")
        part.coalesce(1).write.mode("append").parquet(folder)
        stream.stream_upsert(stream.read_ticks(spark, folder, EVENTS), path,
                             checkpoint, f"{path}-features").awaitTermination()
    got = read_table(spark, path, stream.BAR_SCHEMA)
    want = ticks(spark, range(4)).withColumn("order", F.struct("ts", "event_id")).groupBy(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        *bar_aggregates("value", "order", F.count(F.lit(1))))
    columns = stream.BAR_SCHEMA.fieldNames()
    rows = sorted(map(tuple, got.select(columns).collect()))
    assert rows == sorted(map(tuple, want.select(columns).collect()))
    # Replaying a batch changes nothing.
    stream.upsert_batch(path)(got.where("symbol = 'x'"), 0)
    again = read_table(spark, path, stream.BAR_SCHEMA)
    assert sorted(map(tuple, again.select(columns).collect())) == rows
    # Features kept in step with each batch equal those of all bars.
    stored = read_table(spark, f"{path}-features", stream.FEATURE_SCHEMA)
    assert_same(stored, compute_features(want, Series(key="symbol")).toPandas(),
                keys=("symbol", "trade_date"))


def test_backlog_in_any_order_loses_nothing(spark):
    """Files of one day each, the newest first, further apart than the allowed lateness."""
    folder, path = scratch_path(spark, "ticks"), scratch_path(spark, "bars")
    for day in (20, 15, 10, 5, 0):
        ticks(spark, (day,)).coalesce(1).write.mode("append").parquet(folder)
    stream.stream_upsert(
        stream.read_ticks(spark, folder, EVENTS), path, scratch_path(spark, "offsets")
    ).awaitTermination()
    want = ticks(spark, (0, 5, 10, 15, 20)).groupBy("event_type", F.to_date("ts")).count().count()
    assert read_table(spark, path, stream.BAR_SCHEMA).count() == want > 0


def test_repeated_deliveries_count_once(spark):
    """Files twice, in any order, in several batches and from two streams, with ticks that have no id."""
    folder, path = scratch_path(spark, "ticks"), scratch_path(spark, "bars")
    plain = ticks(spark, range(6)).withColumn("event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_id")))
    for day in (5, 0, 3, 0, 1, 4, 2, 5, 3):
        plain.where(F.dayofmonth("ts") == 1 + day).coalesce(1).write.mode("append").parquet(folder)
    late = plain.where("hour(ts) = 3")
    late.coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        stream.stream_upsert(
            stream.read_ticks(spark, folder, EVENTS, files_per_trigger=4), path, scratch_path(spark, "offsets")
        ).awaitTermination()
    want = plain.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        *bar_aggregates("value", F.struct("ts", "event_id"), F.count(F.lit(1))))
    columns = stream.BAR_SCHEMA.fieldNames()
    got = read_table(spark, path, stream.BAR_SCHEMA)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_first_delivery_of_a_day_counts(spark):
    """Unequal copies of a day in two payloads, in either order."""
    def payload(open_price):
        return ("A", f'{{"s":"ok","t":[1577923200],"o":[{open_price}],"h":[9.0],"l":[0.5],'
                     f'"c":[2.0],"v":[{open_price}]}}')
    for prices in ((1.0, 5.0), (5.0, 1.0)):
        rows = spark.createDataFrame(
            [payload(p) for p in prices], "symbol string, payload string").coalesce(1)
        feed = parse_candles(rows).withColumn("seq", F.monotonically_increasing_id())
        [got] = clean_stock_data(feed).collect()
        assert (got.open, got.volume) == (prices[0], int(prices[0]))


def test_sizing():
    assert sized_for(1 << 30)["spark.sql.shuffle.partitions"] == "200"
    assert sized_for(100 << 40)["spark.sql.shuffle.partitions"] == str(400 << 10)
