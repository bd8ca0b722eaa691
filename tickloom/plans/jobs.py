"""The three batch jobs: backfill, daily update and weekly training."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom import schemas
from tickloom.operators import anomaly, models, training
from tickloom.operators.cleaning import clean_stock_data, load_casts
from tickloom.operators.features import compute_features, price_series, refreshed_features
from tickloom.operators.joins import join_anomaly_input, join_training, lookup_symbol
from tickloom.operators.quality import quality_gate, validate_quality
from tickloom.session import written_once
from tickloom.sinks import tables as sink
from tickloom.sources.payloads import parse_candles
from tickloom.sources.tables import LATEST_LOOKBACK_DAYS, backfill_window, latest_bar


@dataclass(frozen=True)
class Store:
    """Where the stored tables and the models live."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        schema = {
            "stocks": schemas.STOCKS, "prices": schemas.PRICES, "features": schemas.FEATURES,
            "predictions": schemas.PREDICTIONS, "anomalies": schemas.ANOMALIES}[name]
        return sink.read_table(spark, self.path(name), schema)


def register_stocks(spark: SparkSession, store: Store, wanted: DataFrame) -> DataFrame:
    """Adds unknown symbols to the stock table and returns the table."""
    known = store.read(spark, "stocks")
    added = sink.ensure_stocks(known, wanted).join(known, "symbol", "left_anti")
    added.select(*schemas.STOCKS.fieldNames()).write.mode("append").parquet(store.path("stocks"))
    return store.read(spark, "stocks")


def load_bars(
    spark: SparkSession, store: Store, feed: DataFrame, stocks: DataFrame, on_fail: str = "warn",
    loaded_at: dt.datetime | None = None,
) -> None:
    """Cleans a feed, applies the quality policy and upserts the bars."""
    clean = clean_stock_data(feed)
    if on_fail != "warn":
        clean = quality_gate(clean, validate_quality(clean), on_fail)
    bars = load_casts(clean).join(stocks.select("stock_id", "symbol"), "symbol").select(
        "stock_id", F.col("date").alias("trade_date"),
        *[F.col(c).alias(f"{c}_price") for c in ("open", "high", "low", "close")],
        "volume", "seq")
    sink.upsert_prices(spark, store.path("prices"), bars, schemas.PRICES, loaded_at)


def refresh_features(
    spark: SparkSession, store: Store, loaded_at: dt.datetime | None = None,
    since: dt.date | None = None,
) -> DataFrame:
    """Computes and upserts the features of all stored bars, or of those from ``since`` on."""
    bars = price_series(store.read(spark, "prices"))
    features = compute_features(bars) if since is None else refreshed_features(bars, since)
    sink.upsert_features(spark, store.path("features"), features, schemas.FEATURES, loaded_at)
    return store.read(spark, "features")


def backfill(
    spark: SparkSession, store: Store, payloads: DataFrame, universe: DataFrame,
    as_of: dt.date | None = None, on_fail: str = "warn", loaded_at: dt.datetime | None = None,
) -> DataFrame:
    """Registers the universe, loads its candle payloads and derives the features."""
    stocks = register_stocks(spark, store, universe)
    # Rows are numbered as they land, so that of a day delivered twice the first delivery counts.
    rows = parse_candles(payloads).withColumn("seq", F.monotonically_increasing_id())
    if as_of is not None:
        rows = backfill_window(rows.withColumnRenamed("date", "trade_date"), as_of) \
            .withColumnRenamed("trade_date", "date")
    load_bars(spark, store, rows, stocks, on_fail, loaded_at)
    return refresh_features(spark, store, loaded_at)


def weekly_training(
    spark: SparkSession, store: Store, names: tuple[str, ...] = training.MODEL_NAMES, **settings
) -> tuple[DataFrame, DataFrame]:
    """Fits and saves all models; returns the report and the best model per symbol."""
    joined = join_training(store.read(spark, "prices"), store.read(spark, "features"))
    split = written_once(training.training_split(joined))
    fitted, metrics = models.train_models(split, names, **settings)
    for name, model in fitted.items():
        models.save_model(model, store.path("models"), name)
    metrics = written_once(metrics)
    best = training.compare_models(lookup_symbol(metrics, store.read(spark, "stocks")))
    return training.train_report(joined, split, metrics, names), best


def daily_update(
    spark: SparkSession, store: Store, feed: DataFrame, as_of: dt.date,
    names: tuple[str, ...] = training.MODEL_NAMES, trees: int = anomaly.TREES,
    loaded_at: dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Loads the latest bars, refreshes features, appends predictions and anomalies."""
    days = feed.withColumn("trade_date", F.to_date("date"))
    stocks = store.read(spark, "stocks")
    numbered = days.join(stocks.select("stock_id", "symbol"), "symbol")
    recent = latest_bar(numbered, as_of).withColumn("date", F.col("trade_date"))
    load_bars(spark, store, recent.drop("stock_id", "trade_date"), stocks, loaded_at=loaded_at)
    features = refresh_features(
        spark, store, loaded_at, since=as_of - dt.timedelta(days=LATEST_LOOKBACK_DAYS))
    prices = store.read(spark, "prices")
    latest = training.latest_features(features)
    scored = []
    for name in names:
        model = models.load_model(spark, store.path("models"), name)
        if model is not None:
            scored.append(models.predict_next_close(latest, model, name))
    if scored:
        sink.append_rows(spark, store.path("predictions"), models.union_predictions(*scored),
                         schemas.PREDICTIONS, loaded_at)
    flagged = anomaly.detect_anomalies(join_anomaly_input(prices, features), trees=trees)
    sink.append_rows(spark, store.path("anomalies"), flagged, schemas.ANOMALIES, loaded_at)
    return store.read(spark, "predictions"), store.read(spark, "anomalies")
