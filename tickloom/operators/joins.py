"""The joins between prices, features, predictions, anomalies and the stock dimension.

All are equi-joins. A side is broadcast when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` or, in ``join_per_stock``, its row count is below a limit;
a skewed sort-merge join is split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.session import written_once

from tickloom.schemas import FEATURE_COLUMNS

DAY = ["stock_id", "trade_date"]
BROADCAST_ROWS = 100_000
SALTS = 64


def join_per_stock(
    rows: DataFrame, per_stock: DataFrame, on: Sequence[str] = ("stock_id",),
    broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Rows with the values of their instrument, without gathering an instrument's rows.

    ``per_stock`` has one short row per key and is written out first. It is broadcast if it has few
    rows. Otherwise each of its rows is copied ``salts`` times and an instrument's rows are
    spread over the copies; aggregating by instrument afterwards combines before it shuffles.
    """
    table = written_once(per_stock)
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), list(on))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"]).drop("_salt")


def join_training(prices: DataFrame, features: DataFrame) -> DataFrame:
    return prices.select(*DAY, "close_price").join(
        features.select(*DAY, *FEATURE_COLUMNS), DAY)


def join_anomaly_input(prices: DataFrame, features: DataFrame) -> DataFrame:
    return prices.select(*DAY, "close_price", "volume").join(
        features.select(*DAY, "daily_return", "volatility"), DAY)


def join_pred_actual(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """Predictions with the close of their day, NULL while it is in the future."""
    actual = prices.select(
        "stock_id", F.col("trade_date").alias("prediction_date"), "close_price")
    return predictions.join(actual, ["stock_id", "prediction_date"], "left")


def join_anomaly_price(anomalies: DataFrame, prices: DataFrame) -> DataFrame:
    """Flagged days with their close."""
    return anomalies.where("anomaly_flag").join(
        prices.select(*DAY, "close_price"), DAY, "left")


def semi_features(features: DataFrame, prices: DataFrame) -> DataFrame:
    """Features of the days that occur in the selected prices."""
    return features.join(prices.select(*DAY), DAY, "left_semi")


def lookup_symbol(rows: DataFrame, stocks: DataFrame, fallback: bool = True) -> DataFrame:
    """Adds the symbol; an unknown id becomes ``stock_<id>``, or NULL without the fallback."""
    named = rows.join(stocks.select("stock_id", "symbol"), "stock_id", "left")
    if not fallback:
        return named
    made_up = F.concat(F.lit("stock_"), F.col("stock_id"))
    return named.withColumn("symbol", F.coalesce("symbol", made_up))


def stocks_with_prices(stocks: DataFrame, prices: DataFrame) -> DataFrame:
    return prices.join(stocks.select("stock_id", "symbol", "company_name"), "stock_id")


def symbol_maps(stocks: DataFrame) -> DataFrame:
    """Both lookup maps as rows: id to symbol, and symbol to company name."""
    by_id = stocks.select(F.lit("symbol_by_id").alias("map_name"),
                          F.col("stock_id").cast("string").alias("key"),
                          F.col("symbol").alias("value"))
    by_symbol = stocks.select(F.lit("name_by_symbol").alias("map_name"),
                              F.col("symbol").alias("key"), F.col("company_name").alias("value"))
    return by_id.unionByName(by_symbol)
