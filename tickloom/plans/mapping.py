"""Market tables derived from the star-schema and event tables.

Line items are trades of a brand on its ship date; events are ticks of an event type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.scalars import next_business_day, ratio, sort_key
from tickloom.operators.features import compute_features, price_series
from tickloom.operators.training import MODEL_NAMES
from tickloom.sinks.tables import number_symbols

LOADED_AT = dt.datetime(2024, 1, 1)


# Columns read from the given tables; declared, so that opening a table starts no job.
COLUMNS = {
    "part": "p_partkey bigint, p_brand string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock dimension: brands numbered in order."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"))
    return number_symbols(brands).withColumn("company_name", F.col("symbol"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their price and the order among them.

    Nothing shorter than the whole struct identifies a trade.
    """
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     "l_quantity")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        "symbol", F.to_date("l_shipdate").alias("trade_date"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"), order.alias("trade_order"))


def tick_order(ts: str) -> Column:
    """Ticks by time, then id."""
    return sort_key(F.unix_micros(F.col(ts).cast("timestamp")), ("event_id", 19))


def bar_aggregates(price: str, order: str, volume: Column) -> list[Column]:
    return [
        F.min_by(price, order).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        volume.cast("bigint").alias("volume"),
    ]


def symbol_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by symbol."""
    return trades(spark, sf_dir).groupBy("symbol", "trade_date").agg(
        *bar_aggregates("price", "trade_order", F.sum("quantity")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by stock_id, under the short names."""
    return symbol_bars(spark, sf_dir).join(stocks(spark, sf_dir), "symbol").select(
        "stock_id", "trade_date", "open", "high", "low", "close", "volume")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table."""
    return bars(spark, sf_dir).select(
        "stock_id", "trade_date",
        *[F.col(c).alias(f"{c}_price") for c in ("open", "high", "low", "close")], "volume")


def features(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return compute_features(price_series(prices(spark, sf_dir)), keep=keep)


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw text feed with the defects of one: many rows a day, gaps, junk, fractions, zeros.

    A defect is a function of the row's own values.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts").cast("date").cast("string").alias("date"),
        F.when(k < 5, "n/a").otherwise(value.cast("string")).alias("open"),
        F.when(k == 7, (value - 1).cast("string")).otherwise((value + 1).cast("string"))
        .alias("high"),
        F.when(k == 11, F.lit("-1.0")).otherwise((value - 0.5).cast("string")).alias("low"),
        F.when(k > 94, F.lit(None)).otherwise(value.cast("string")).alias("close"),
        F.when(k == 13, "0").when(k == 17, "2.5").otherwise(k.cast("string")).alias("volume"),
    )


def naive_predictions(prices: DataFrame) -> DataFrame:
    """A prediction table whose models repeat the close or one of its averages."""
    rows = compute_features(price_series(prices), keep=("close",))
    values = zip(MODEL_NAMES, ("close", "ma_7", "ma_30"))
    model = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model_name"), F.col(value).alias("predicted_close"))
        for name, value in values]))
    return rows.select(
        "stock_id", next_business_day("trade_date").alias("prediction_date"), "trade_date",
        model.alias("m")).select(
        "stock_id", "prediction_date", "m.predicted_close", "m.model_name",
        F.col("trade_date").cast("timestamp_ntz").alias("created_at"))


def naive_anomalies(prices: DataFrame, width: float = 0.8) -> DataFrame:
    """An anomaly table that flags large moves."""
    score = F.lit(width) - F.abs("daily_return")
    return compute_features(price_series(prices)).where(F.col("daily_return").isNotNull()).select(
        "stock_id", "trade_date", score.alias("anomaly_score"),
        (score < 0).alias("anomaly_flag"), F.lit("isolation_forest").alias("model_name"),
        F.col("trade_date").cast("timestamp_ntz").alias("created_at"))
