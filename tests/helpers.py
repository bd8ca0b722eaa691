"""Small random markets and plain pandas versions of the per-instrument operators."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import types as T

START = dt.date(2020, 1, 1)
BAR_SCHEMA = T.StructType([
    T.StructField("stock_id", T.IntegerType()), T.StructField("trade_date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
    T.StructField("volume", T.LongType())])


def random_bars(seed, lengths, gap=4, null_share=0.0, zero_share=0.0):
    """Bars with random gaps; ``lengths`` gives the rows of each instrument."""
    random = np.random.default_rng(seed)
    rows = []
    for stock_id, length in enumerate(lengths, start=1):
        days = np.cumsum(random.integers(1, gap + 1, length))
        for day in days:
            opening, close = random.uniform(5, 50, 2).round(2)
            high, low = max(opening, close) + 1, min(opening, close) - 1
            if random.random() < null_share:
                close = None
            if random.random() < zero_share:
                opening = 0.0
            volume = 0 if random.random() < zero_share else int(random.integers(1, 1000))
            rows.append((stock_id, START + dt.timedelta(days=int(day)), float(opening),
                         float(high), float(low), None if close is None else float(close),
                         volume))
    return rows


def to_pandas_bars(rows):
    frame = pd.DataFrame(rows, columns=BAR_SCHEMA.fieldNames())
    frame["close"] = frame["close"].astype(float)
    return frame.sort_values(["stock_id", "trade_date"]).reset_index(drop=True)


def pandas_features(frame):
    parts = []
    for _, g in frame.groupby("stock_id"):
        if len(g) < 2:
            continue
        filled = g["close"].ffill()
        opening = g["open"].replace(0, np.nan)
        parts.append(pd.DataFrame({
            "stock_id": g["stock_id"], "trade_date": g["trade_date"],
            "daily_return": filled / filled.shift(1) - 1,
            "price_difference": g["close"] - g["open"],
            "volatility": (g["high"] - g["low"]) / opening,
            "ma_7": g["close"].rolling(7, min_periods=1).mean(),
            "ma_30": g["close"].rolling(30, min_periods=1).mean(),
            "capital_flow_indicator": g["volume"] * (g["close"] - g["open"]) / opening}))
    return pd.concat(parts).reset_index(drop=True)


def pandas_flow(frame):
    parts = []
    for _, g in frame.groupby("stock_id"):
        if len(g) < 15:
            continue
        typical = (g["high"] + g["low"] + g["close"]) / 3
        money = typical * g["volume"]
        direction = np.sign(typical.diff()).fillna(0).astype(int)
        inflow, outflow = money.where(direction == 1, 0.0), money.where(direction == -1, 0.0)
        in_14 = inflow.rolling(14, min_periods=1).apply(np.sum, raw=True)
        out_14 = outflow.rolling(14, min_periods=1).apply(np.sum, raw=True)
        ratio = in_14 / out_14.where(out_14 != 0)
        parts.append(pd.DataFrame({
            "stock_id": g["stock_id"], "trade_date": g["trade_date"], "typical_price": typical,
            "raw_money_flow": money, "flow_direction": direction, "inflow": inflow,
            "outflow": outflow, "mfi_14": 100 - 100 / (1 + ratio), "net_flow": inflow - outflow,
            "cumulative_flow": (inflow - outflow).cumsum()}))
    return pd.concat(parts).reset_index(drop=True)


def assert_same(spark_frame, expected, keys=("stock_id", "trade_date")):
    """Equal rows and, up to rounding errors, equal numbers."""
    got = spark_frame.toPandas()[list(expected.columns)].sort_values(list(keys))
    want = expected.sort_values(list(keys))
    assert len(got) == len(want)
    for name in want.columns:
        a, b = got[name].to_numpy(), want[name].to_numpy()
        if np.issubdtype(np.asarray(b).dtype, np.number):
            np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-7,
                                       err_msg=name)
        else:
            assert list(a) == list(b), name
