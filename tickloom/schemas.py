"""Declared schemas of the stored tables and of the payloads the sources parse."""

from __future__ import annotations

from pyspark.sql import types as T

STOCKS = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("company_name", T.StringType()),
])

PRICES = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("open_price", T.DoubleType()),
    T.StructField("high_price", T.DoubleType()),
    T.StructField("low_price", T.DoubleType()),
    T.StructField("close_price", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

FEATURES = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("daily_return", T.DoubleType()),
    T.StructField("price_difference", T.DoubleType()),
    T.StructField("volatility", T.DoubleType()),
    T.StructField("ma_7", T.DoubleType()),
    T.StructField("ma_30", T.DoubleType()),
    T.StructField("capital_flow_indicator", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

PREDICTIONS = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("prediction_date", T.DateType()),
    T.StructField("predicted_close", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ANOMALIES = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("anomaly_flag", T.BooleanType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

_PRICE_ARRAY = T.ArrayType(T.DoubleType())

CANDLE_PAYLOAD = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("t", T.ArrayType(T.LongType())),
    *[T.StructField(name, _PRICE_ARRAY) for name in ("o", "h", "l", "c", "v")],
])

QUOTE_PAYLOAD = T.StructType([
    *[T.StructField(name, T.DoubleType()) for name in ("o", "h", "l", "c", "pc")],
    T.StructField("t", T.LongType()),
])

HISTORY_FILE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.LongType()),
])

OHLCV = ("open", "high", "low", "close", "volume")
PRICE_COLUMNS = ("open_price", "high_price", "low_price", "close_price")
FEATURE_COLUMNS = (
    "daily_return", "price_difference", "volatility", "ma_7", "ma_30", "capital_flow_indicator",
)
ANOMALY_FEATURES = ("daily_return", "volatility", "volume_change_pct")
