"""Readers over the stored tables, each a filter, projection and order of one table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The default universe, symbol to company name.
TARGET_STOCKS = {
    "AAPL": "Apple Inc.",
    "MSFT": "Microsoft Corporation",
    "NVDA": "NVIDIA Corporation",
    "AMZN": "Amazon.com Inc.",
    "GOOGL": "Alphabet Inc.",
    "META": "Meta Platforms Inc.",
    "TSLA": "Tesla Inc.",
}
BACKFILL_DAYS = 365
LATEST_LOOKBACK_DAYS = 3


def target_universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TARGET_STOCKS.items()), "symbol string, company_name string")


def restrict_to_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the instruments in the universe, with the company name.

    No broadcast hint: a small universe is broadcast by its measured size, a large one is not.
    """
    return bars.join(universe.select("symbol", "company_name"), "symbol")


def scan_stocks(stocks: DataFrame) -> DataFrame:
    return stocks.select("stock_id", "symbol", "company_name").orderBy("symbol")


def _of_stock(table: DataFrame, stock_id: int | None) -> DataFrame:
    return table if stock_id is None else table.where(F.col("stock_id") == stock_id)


def select_prices(
    prices: DataFrame,
    stock_id: int | None = None,
    days: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Prices of one instrument and of the last ``days`` days if given, in no order."""
    rows = _of_stock(prices, stock_id)
    if days is not None:
        today: Column = F.current_date() if as_of is None else F.lit(as_of)
        rows = rows.where(F.col("trade_date") >= F.date_sub(today, days))
    return rows


def load_prices(
    prices: DataFrame,
    stock_id: int | None = None,
    days: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Prices in date order, of one instrument and of the last ``days`` days if given."""
    return select_prices(prices, stock_id, days, as_of).orderBy("trade_date", "stock_id")


def load_features(features: DataFrame, stock_id: int | None = None) -> DataFrame:
    return _of_stock(features, stock_id).orderBy("trade_date", "stock_id")


def load_predictions(predictions: DataFrame, stock_id: int | None = None) -> DataFrame:
    return _of_stock(predictions, stock_id).orderBy(
        F.desc("prediction_date"), "stock_id", "model_name")


def load_anomalies(anomalies: DataFrame, stock_id: int | None = None) -> DataFrame:
    return _of_stock(anomalies, stock_id).orderBy(F.desc("trade_date"), "stock_id")


def backfill_window(bars: DataFrame, as_of: dt.date, days: int = BACKFILL_DAYS) -> DataFrame:
    """Bars of the ``days`` calendar days up to ``as_of``."""
    return bars.where(
        F.col("trade_date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))


def latest_bar(
    prices: DataFrame, as_of: dt.date, lookback: int = LATEST_LOOKBACK_DAYS
) -> DataFrame:
    """The last bar of each instrument within the few days up to ``as_of``.

    Of several on that day, the first delivered (``seq``, where there is one), then the one with the
    smallest values, taken as a whole.
    """
    recent = backfill_window(prices, as_of, lookback)
    values = [c for c in prices.columns if c not in ("stock_id", "trade_date", "seq")]
    order = ["seq"] if "seq" in prices.columns else []
    age = F.datediff(F.lit(as_of), F.col("trade_date")).alias("age")
    last = recent.groupBy("stock_id").agg(
        F.min(F.struct(age, *order, *values, "trade_date")).alias("last"))
    return last.select("stock_id", F.col("last.trade_date").alias("trade_date"), *[
        F.col("last")[c].alias(c) for c in prices.columns if c in (*order, *values)])
