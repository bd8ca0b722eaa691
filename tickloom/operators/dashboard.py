"""Queries behind the market overview, stock, prediction and anomaly pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions import scalars as S
from tickloom.functions.scalars import ratio
from tickloom.operators.joins import join_per_stock, join_pred_actual, lookup_symbol, semi_features
from tickloom.sources.tables import select_prices

HISTORY_ROWS, RECENT_ANOMALIES = 50, 20
# The lookbacks in days and the chart ranges in months.
LOOKBACK_DAYS = {"30 Days": 30, "90 Days": 90, "180 Days": 180, "1 Year": 365, "All": None}
RANGE_MONTHS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12}


def market_overview(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """Latest bar against the one before, for every stock with two bars.

    Ranking alone in its window lets Spark cut each stock to two rows before the shuffle.
    """
    latest_first = W.partitionBy("stock_id").orderBy(F.desc("trade_date"))
    two = prices.withColumn("_rank", F.row_number().over(latest_first)).where(F.col("_rank") <= 2)

    def of(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    summary = two.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        of(1, "close_price").alias("close"),
        of(2, "close_price").alias("prev_close"),
        of(1, "high_price").alias("high"),
        of(1, "low_price").alias("low"),
        of(1, "volume").alias("volume"),
        of(1, "trade_date").alias("trade_date"),
    ).where(F.col("_rows") == 2)
    change = F.col("close") - F.col("prev_close")
    return (
        summary.withColumn("change", change)
        .withColumn("change_pct", ratio(change, F.col("prev_close")) * 100)
        .join(stocks.select("stock_id", "symbol", "company_name"), "stock_id")
        .select("symbol", "company_name", "close", "change", "change_pct", "high", "low",
                "volume", "trade_date")
    )


def kpi_cards(overview: DataFrame) -> DataFrame:
    return overview.select(
        "symbol", S.money("close").alias("value"),
        S.delta_text("change", "change_pct").alias("delta"))


def heatmap_series(overview: DataFrame) -> DataFrame:
    return overview.select("symbol", "change_pct", S.signed_percent("change_pct").alias("label"))


def volume_comparison(overview: DataFrame) -> DataFrame:
    return overview.select("symbol", "volume", S.grouped_count("volume").alias("label"))


def summary_table(overview: DataFrame) -> DataFrame:
    return overview.select(
        "symbol", "company_name",
        *[S.money(c).alias(c) for c in ("close", "high", "low")],
        S.signed("change").alias("change"),
        S.signed_percent("change_pct").alias("change_pct"),
        S.grouped_count("volume").alias("volume"),
        S.day_text("trade_date").alias("trade_date"),
    )


def _kpis(inside: Column) -> list[Column]:
    """The aggregates of the rows of a lookback."""
    def of(name: str) -> Column:
        return F.when(inside, F.col(name))

    return [
        F.min_by("close_price", of("trade_date")).alias("first_close"),
        F.max_by("close_price", of("trade_date")).alias("latest_close"),
        F.avg(of("volume")).alias("avg_volume"), F.max(of("high_price")).alias("period_high"),
        F.min(of("low_price")).alias("period_low"), F.count_if(inside).alias("_rows")]


def period_kpis_of(
    prices: DataFrame, lookbacks: dict[str, int | None], as_of: dt.date
) -> DataFrame:
    """Per stock and lookback, the first against the last close and the extremes.

    ``lookbacks`` gives a number of days up to ``as_of`` for each name, or None for all. One scan and one
    aggregation serve all of them: a row counts in every lookback that it lies in.
    """
    parts, names = [], []
    for i, (name, days) in enumerate(lookbacks.items()):
        inside = F.lit(True) if days is None else F.col("trade_date") >= F.lit(as_of - dt.timedelta(days=days))
        columns = _kpis(F.coalesce(inside, F.lit(False)))
        fields = ["first_close", "latest_close", "avg_volume", "period_high", "period_low", "_rows"]
        parts += [c.alias(f"_{i}_{f}") for c, f in zip(columns, fields)]
        names.append(F.struct(F.lit(name).alias("lookback"), *[F.col(f"_{i}_{f}").alias(f) for f in fields]))
    rows = prices.groupBy("stock_id").agg(*parts).select("stock_id", F.inline(F.array(*names)))
    change = F.col("latest_close") - F.col("first_close")
    return rows.where(F.col("_rows") > 0).drop("_rows").withColumn("period_change", change).withColumn(
        "period_change_pct", ratio(change, F.col("first_close")) * 100)


def period_kpis(prices: DataFrame, days: int | None = None, as_of: dt.date | None = None) -> DataFrame:
    """First against last close and the extremes of the lookback, per stock."""
    rows = select_prices(prices, days=days, as_of=as_of)
    return period_kpis_of(rows, {"all": None}, dt.date.max).drop("lookback")


def candle_color() -> Column:
    return F.when(F.col("close_price") >= F.col("open_price"), "up").otherwise("down")


def indicator_color(column: str, null_is_up: bool) -> Column:
    value = F.coalesce(F.col(column), F.lit(0.0)) if null_is_up else F.col(column)
    return F.when(value >= 0, "up").otherwise("down")


def indicator_colors(features: DataFrame) -> DataFrame:
    """Sign classes of two indicators; an unknown return is down, an unknown flow is up."""
    return features.select(
        "stock_id", "trade_date",
        indicator_color("daily_return", null_is_up=False).alias("return_color"),
        indicator_color("capital_flow_indicator", null_is_up=True).alias("flow_color"))


def candles_with_ma(
    prices: DataFrame, features: DataFrame, days: int | None = None, as_of: dt.date | None = None
) -> DataFrame:
    """Candles of the lookback with their colour and both moving averages."""
    rows = select_prices(prices, days=days, as_of=as_of)
    averages = semi_features(features, rows).select("stock_id", "trade_date", "ma_7", "ma_30")
    return rows.withColumn("color", candle_color()).join(
        averages, ["stock_id", "trade_date"], "left")


def distinct_models(predictions: DataFrame) -> DataFrame:
    """Models, the one with the newest prediction first."""
    return (
        predictions.groupBy("model_name")
        .agg(F.max("prediction_date").alias("latest_prediction"))
        .orderBy(F.desc("latest_prediction"), "model_name")
    )


def _newest_first(*partition: str) -> W:
    return W.partitionBy(*partition).orderBy(
        F.desc("prediction_date"), F.desc("created_at"), F.desc("predicted_close"))


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each stock and model."""
    rank = F.row_number().over(_newest_first("stock_id", "model_name"))
    return (
        predictions.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
        .withColumn("model_title", S.model_title("model_name"))
    )


def prediction_accuracy(predictions: DataFrame, prices: DataFrame) -> DataFrame:
    """Error statistics per stock and model where the actual close is known."""
    known = join_pred_actual(predictions, prices).where(F.col("close_price").isNotNull())
    error = F.abs(F.col("predicted_close") - F.col("close_price"))
    return known.groupBy("stock_id", "model_name").agg(
        F.avg(error).alias("mae"),
        F.avg(ratio(error, F.col("close_price")) * 100).alias("avg_error_pct"),
        F.count(F.lit(1)).alias("predictions"),
    )


def prediction_history(predictions: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The newest predictions of each stock and model, formatted."""
    rank = F.row_number().over(_newest_first("stock_id", "model_name"))
    return predictions.withColumn("_rank", rank).where(F.col("_rank") <= rows).select(
        "stock_id", S.day_text("prediction_date").alias("prediction_date"),
        S.money("predicted_close").alias("predicted_close"), "model_name", "created_at")


def alert_summary(anomalies: DataFrame, stocks: DataFrame) -> DataFrame:
    """Flagged days per stock: how many, their mean score and the last of them."""
    flagged = anomalies.where("anomaly_flag").groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.avg("anomaly_score").alias("avg_score"),
        F.max("trade_date").alias("latest_date"),
    )
    return lookup_symbol(flagged, stocks, fallback=False)


def recent_anomalies(anomalies: DataFrame, rows: int = RECENT_ANOMALIES) -> DataFrame:
    """The newest flagged days of each stock, formatted."""
    newest = W.partitionBy("stock_id").orderBy(F.desc("trade_date"), "anomaly_score")
    return (
        anomalies.where("anomaly_flag").withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= rows)
        .select("stock_id", S.day_text("trade_date").alias("trade_date"),
                S.decimals("anomaly_score", 4).alias("anomaly_score"), "model_name")
    )


def score_timeline(anomalies: DataFrame) -> DataFrame:
    """All scores with the decision boundary at zero."""
    return anomalies.select(
        "stock_id", "trade_date", "anomaly_score",
        F.lit(0.0).alias("boundary"), (F.col("anomaly_score") < 0).alias("below_boundary"))


def _range_start(button: str) -> Column:
    if button == "all":
        return F.lit(None).cast("date")
    return (F.trunc("_last", "year") if button == "ytd"
            else F.add_months("_last", -RANGE_MONTHS[button]))


def range_slice(rows: DataFrame, button: str) -> DataFrame:
    """Rows within a chart range that ends at each stock's last date."""
    if button == "all":
        return rows
    last = rows.groupBy("stock_id").agg(F.max("trade_date").alias("_last"))
    return rows.join(last, "stock_id").where(F.col("trade_date") >= _range_start(button)).drop("_last")


def range_extents(rows: DataFrame, buttons: Sequence[str]) -> DataFrame:
    """Per stock and chart range the number of rows and the first and last date.

    One scan finds the last dates and one aggregates all ranges.
    """
    last = rows.groupBy("stock_id").agg(F.max("trade_date").alias("_last"))
    day, parts, names = F.col("trade_date"), [], []
    for i, button in enumerate(buttons):
        inside = F.coalesce(day >= _range_start(button), F.lit(button == "all"))
        parts += [F.count_if(inside).alias(f"_{i}_rows"), F.min(F.when(inside, day)).alias(f"_{i}_first_date"),
                  F.max(F.when(inside, day)).alias(f"_{i}_last_date")]
        names.append(F.struct(F.lit(button).alias("button"), *[
            F.col(f"_{i}_{f}").alias(f) for f in ("rows", "first_date", "last_date")]))
    return join_per_stock(rows.select("stock_id", "trade_date"), last).groupBy("stock_id").agg(*parts).select(
        "stock_id", F.inline(F.array(*names))).where(F.col("rows") > 0)
