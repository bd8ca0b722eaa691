"""One named query per operator, each over the whole given tables.

Results are rounded where the order of floating-point sums may differ between engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom import schemas
from tickloom.functions import scalars as S
from tickloom.operators import (
    anomaly, boosting, capital_flow as flow, cleaning, dashboard, features as feat, joins, linear, models,
    quality, training, trees,
)
from tickloom.plans import jobs, mapping as m
from tickloom.session import scratch_path, written_once
from tickloom.sinks import tables as sink
from tickloom.sources import deliveries, payloads, tables as src
from tickloom.streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = dt.date(2001, 11, 1)
CUT, OVERLAP = dt.date(1999, 1, 1), dt.date(1998, 1, 1)
ONE_STOCK = 7


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def rounded(df: DataFrame, places: int = 6, only: Iterable[str] | None = None) -> DataFrame:
    """Doubles rounded half up, negative zero made zero."""
    doubles = [c for c, t in df.dtypes if t == "double" and (only is None or c in only)]
    scale = float(10 ** places)
    return df.withColumns({
        c: F.floor(F.col(c) * scale + 0.5).cast("double") / scale for c in doubles})


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.compute_capital_flow(feat.price_series(m.prices(spark, sf_dir)))


def _stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price table as stored, for queries that read it more than once."""
    return written_once(m.prices(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _stored_prices(spark, sf_dir)
    return joins.join_training(prices, feat.compute_features(feat.price_series(prices)))


def _anomaly_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _stored_prices(spark, sf_dir)
    return joins.join_anomaly_input(prices, feat.compute_features(feat.price_series(prices)))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_split(_joined(spark, sf_dir))


def _stored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(_split(spark, sf_dir))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.market_overview(m.prices(spark, sf_dir), m.stocks(spark, sf_dir))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_stock_data(m.event_feed(spark, sf_dir))


# --- sources ---------------------------------------------------------------------------------

def candle_payloads(bars: DataFrame) -> DataFrame:
    """One payload per symbol and calendar year, at most a year of days each, and an empty one."""
    day = F.struct(F.unix_seconds(F.col("trade_date").cast("timestamp")).alias("t"),
                   F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                   F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    years = bars.groupBy("symbol", F.year("trade_date").alias("year")).agg(
        F.sort_array(F.collect_list(day)).alias("d"))
    full = years.select("symbol", F.to_json(F.struct(
        F.lit("ok").alias("s"), *[F.col(f"d.{c}").alias(c) for c in "tohlcv"])).alias("payload"))
    empty = bars.select("symbol").distinct().withColumn("payload", F.lit('{"s": "no_data"}'))
    return full.unionByName(empty)


@query("parse_candles")
def parse_candles(spark, sf_dir):
    return rounded(payloads.parse_candles(candle_payloads(m.symbol_bars(spark, sf_dir))))


@query("read_history")
def read_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    bars = m.symbol_bars(spark, sf_dir)
    bars.select(
        "symbol", F.date_format("trade_date", "yyyy-MM-dd 00:00:00-05:00").alias("Date"),
        *[F.col(c).alias(c.capitalize()) for c in schemas.OHLCV],
    ).write.option("header", True).csv(path)
    return rounded(payloads.read_history(spark, path))


@query("resolve_sources")
def resolve_sources(spark, sf_dir):
    bars = written_once(m.symbol_bars(spark, sf_dir))
    first = bars.where((F.col("symbol") < "Brand#2") & (F.col("volume") >= 10))
    return rounded(payloads.resolve_sources(first, bars))


@query("failing_deliveries")
def failing_deliveries(spark, sf_dir):
    """What is used of four sources, of which three fail in part, and what is quarantined."""
    bars = written_once(m.symbol_bars(spark, sf_dir))
    folder = scratch_path(spark, "deliveries")
    last, tens = F.substring("symbol", -1, 1), F.substring("symbol", -2, 1)
    # Cut payloads, and answers without data.
    payload = F.when(last == "2", F.expr("substr(payload, 1, length(payload) - 40)")).when(
        last == "3", F.lit('{"s":"no_data"}')).otherwise(F.col("payload"))
    candle_payloads(bars).select("symbol", payload.alias("payload")).write.json(f"{folder}/candles")
    # Lines that end in the middle.
    cut = (last == "2") & (tens >= "1") & (F.col("volume") % 10 == 0)
    fields = [F.col("symbol"), F.date_format("trade_date", "yyyy-MM-dd 00:00:00"),
              *[F.col(c).cast("string") for c in schemas.OHLCV]]
    history = bars.select(F.when(cut, F.concat_ws(",", *fields[:4])).otherwise(F.concat_ws(",", *fields)))
    history.write.text(f"{folder}/history")
    bars.select("symbol", F.date_format("trade_date", "yyyy-MM-dd").alias("Date"),
                *[F.col(c).alias(c.capitalize()) for c in schemas.OHLCV]).write.json(f"{folder}/archive")
    used, quarantine = deliveries.deliver(
        spark, deliveries.Source("candles", f"{folder}/candles", "candles"),
        deliveries.Source("absent", f"{folder}/absent", "csv"),
        deliveries.Source("history", f"{folder}/history", "csv", header=False),
        deliveries.Source("archive", f"{folder}/archive", "json"))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols")]
    return used.groupBy("source").agg(F.sum("volume").alias("volume"), *counts).select(
        "source", F.lit("used").alias("fate"), "rows", "symbols", "volume").unionByName(
        quarantine.groupBy("source", F.col("reason").alias("fate")).agg(*counts).withColumn(
            "volume", F.lit(None).cast("bigint")))


@query("parse_quotes")
def parse_quotes(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    quote = F.struct(
        F.when(k == 7, 0.0).when(k >= 5, F.col("value")).alias("o"),
        (F.col("value") + 1).alias("h"), (F.col("value") - 1).alias("l"),
        F.col("value").alias("c"), F.col("value").alias("pc"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    landed = m.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.to_json(quote).alias("payload"))
    return rounded(payloads.parse_quotes(landed))


@query("latest_bar")
def latest_bar(spark, sf_dir):
    return rounded(src.latest_bar(m.prices(spark, sf_dir), AS_OF))


@query("scan_stocks")
def scan_stocks(spark, sf_dir):
    return src.scan_stocks(m.stocks(spark, sf_dir))


@query("load_prices")
def load_prices(spark, sf_dir):
    return rounded(src.load_prices(m.prices(spark, sf_dir), days=365, as_of=AS_OF))


@query("load_features")
def load_features(spark, sf_dir):
    return rounded(src.load_features(m.features(spark, sf_dir)))


@query("load_predictions")
def load_predictions(spark, sf_dir):
    return rounded(src.load_predictions(m.naive_predictions(m.prices(spark, sf_dir))))


@query("load_anomalies")
def load_anomalies(spark, sf_dir):
    return rounded(src.load_anomalies(m.naive_anomalies(m.prices(spark, sf_dir))))


@query("price_series")
def price_series(spark, sf_dir):
    return rounded(feat.price_series(m.prices(spark, sf_dir)))


@query("backfill_window")
def backfill_window(spark, sf_dir):
    return rounded(src.backfill_window(m.prices(spark, sf_dir), AS_OF))


@query("universe")
def universe(spark, sf_dir):
    wanted = m.stocks(spark, sf_dir).where(F.col("symbol") >= "Brand#2").select(
        "symbol", F.concat("symbol", F.lit(" Inc.")).alias("company_name"))
    return rounded(src.restrict_to_universe(m.symbol_bars(spark, sf_dir), wanted))


# --- sinks -----------------------------------------------------------------------------------

@query("ensure_stocks")
def ensure_stocks(spark, sf_dir):
    brands = m.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"))
    known = sink.number_symbols(brands.where(F.col("symbol") < "Brand#2")).withColumn(
        "company_name", F.col("symbol"))
    wanted = brands.distinct().withColumn("company_name", F.concat("symbol", F.lit(" Inc.")))
    return sink.ensure_stocks(known, wanted)


@query("assert_unique_key")
def assert_unique_key(spark, sf_dir):
    return sink.key_violations(m.trades(spark, sf_dir), ("symbol", "trade_date"))


@query("upsert_prices")
def upsert_prices(spark, sf_dir):
    path = scratch_path(spark, "prices")
    prices = _stored_prices(spark, sf_dir)
    sink.upsert_prices(
        spark, path, prices.where(F.col("trade_date") < F.lit(CUT)).withColumn("seq", F.lit(0)),
        schemas.PRICES, m.LOADED_AT)
    newer = prices.where(F.col("trade_date") >= F.lit(OVERLAP))
    corrected = newer.withColumn("close_price", F.col("close_price") * 2).withColumn(
        "volume", F.when(F.col("volume") > 20, F.col("volume")))
    again = corrected.where(F.col("high_price") > 3000)
    incoming = newer.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))
    sink.upsert_prices(spark, path, incoming, schemas.PRICES, m.LOADED_AT)
    return rounded(sink.read_table(spark, path, schemas.PRICES))


@query("upsert_features")
def upsert_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    features = written_once(m.features(spark, sf_dir))
    sink.upsert_features(spark, path, features.where(F.col("trade_date") < F.lit(CUT)),
                         schemas.FEATURES, m.LOADED_AT)
    newer = features.where(F.col("trade_date") >= F.lit(OVERLAP)).withColumn(
        "volatility", F.when(F.col("volatility") == 0, float("nan"))
        .otherwise(F.col("volatility") + 1))
    sink.upsert_features(spark, path, newer, schemas.FEATURES, m.LOADED_AT)
    return rounded(sink.read_table(spark, path, schemas.FEATURES))


@query("append_predictions")
def append_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    rows = written_once(m.naive_predictions(m.prices(spark, sf_dir)))
    for _ in range(2):
        sink.append_rows(spark, path, rows, schemas.PREDICTIONS, m.LOADED_AT)
    stored = sink.read_table(spark, path, schemas.PREDICTIONS)
    return rounded(stored.groupBy("stock_id", "model_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("predicted_close").alias("total")), 2)


@query("append_anomalies")
def append_anomalies(spark, sf_dir):
    path = scratch_path(spark, "anomalies")
    rows = written_once(m.naive_anomalies(m.prices(spark, sf_dir)).drop("created_at"))
    key = ("stock_id", "trade_date", "model_name")
    sink.append_rows(spark, path, rows, schemas.ANOMALIES, m.LOADED_AT)
    sink.append_rows(spark, path, rows, schemas.ANOMALIES, m.LOADED_AT, dedupe_on=key)
    return rounded(sink.read_table(spark, path, schemas.ANOMALIES))


@query("model_store")
def model_store(spark, sf_dir):
    """Two weeks of models, the second only of even ids: versions, and predictions against the fitted models."""
    folder = scratch_path(spark, "models")
    split = _stored_split(spark, sf_dir)
    even = F.col("stock_id") % 2 == 0
    first = models.train_linear(split.where("is_train"))
    second = models.train_linear(split.where(even))
    models.save_model(first, folder, "linear_regression", m.LOADED_AT)
    models.save_model(second, folder, "linear_regression", m.LOADED_AT + dt.timedelta(days=7))
    fitted = models.LinearModel(second.table.unionByName(first.table.where(~even)))
    again = models.load_model(spark, folder, "linear_regression")
    both = again.predict(fitted.predict(split, "before"), "after")
    found = both.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.abs(F.col("after") - F.col("before"))).alias("max_difference"))
    newest = models.newest_versions(spark, folder, "linear_regression").select(
        "stock_id", "version", F.col("trained_at").cast("date").alias("trained_on"))
    return found.join(newest, "stock_id")


# --- cleaning and quality --------------------------------------------------------------------

@query("drop_null_ohlcv")
def drop_null_ohlcv(spark, sf_dir):
    kept = cleaning.drop_null_ohlcv(m.event_feed(spark, sf_dir))
    return rounded(kept.withColumns({c: S.to_number(c) for c in schemas.OHLCV}))


@query("dedup_dates")
def dedup_dates(spark, sf_dir):
    kept = cleaning.dedup_dates(m.event_feed(spark, sf_dir))
    return rounded(kept.withColumns({c: S.to_number(c) for c in schemas.OHLCV}))


@query("coerce_types")
def coerce_types(spark, sf_dir):
    return rounded(cleaning.coerce_types(m.event_feed(spark, sf_dir)))


@query("clean_stock_data")
def clean_stock_data(spark, sf_dir):
    return rounded(_clean(spark, sf_dir))


@query("cleaning_report")
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(m.event_feed(spark, sf_dir))


for _name, _check in {
    "dq_nulls": quality.null_counts, "dq_zero_volume": quality.zero_volume,
    "dq_nonpositive": quality.non_positive, "dq_high_low": quality.high_below_low,
    "dq_gaps": quality.date_gaps,
}.items():
    query(_name)(lambda spark, sf_dir, check=_check: check(_clean(spark, sf_dir)))


@query("validate_quality")
def validate_quality(spark, sf_dir):
    feed = m.event_feed(spark, sf_dir)
    report = quality.validate_quality(_clean(spark, sf_dir), feed.select("symbol"))
    return report.select("symbol", "passed", F.concat_ws("; ", "issues").alias("issues"))


@query("dq_gate")
def dq_gate(spark, sf_dir):
    clean = written_once(_clean(spark, sf_dir))
    report = quality.validate_quality(clean)
    policies = [quality.quality_gate(clean, report, p).withColumn("policy", F.lit(p))
                for p in ("warn", "drop_symbol")]
    return rounded(policies[0].unionByName(policies[1]))


@query("load_casts")
def load_casts(spark, sf_dir):
    return rounded(cleaning.load_casts(_clean(spark, sf_dir)))


# --- joins -----------------------------------------------------------------------------------

@query("join_training")
def join_training(spark, sf_dir):
    return rounded(_joined(spark, sf_dir))


@query("join_anomaly_input")
def join_anomaly_input(spark, sf_dir):
    return rounded(_anomaly_joined(spark, sf_dir))


@query("join_pred_actual")
def join_pred_actual(spark, sf_dir):
    prices = _stored_prices(spark, sf_dir)
    return rounded(joins.join_pred_actual(m.naive_predictions(prices), prices))


@query("join_anomaly_price")
def join_anomaly_price(spark, sf_dir):
    prices = _stored_prices(spark, sf_dir)
    return rounded(joins.join_anomaly_price(m.naive_anomalies(prices), prices))


@query("semi_features")
def semi_features(spark, sf_dir):
    prices = _stored_prices(spark, sf_dir)
    recent = src.select_prices(prices, days=180, as_of=AS_OF)
    return rounded(joins.semi_features(
        feat.compute_features(feat.price_series(prices)), recent))


@query("lookup_symbol")
def lookup_symbol(spark, sf_dir):
    known = m.stocks(spark, sf_dir).where(F.col("symbol") < "Brand#2")
    rows = m.prices(spark, sf_dir).select("stock_id", "trade_date")
    with_both = joins.lookup_symbol(rows, known).withColumnRenamed("symbol", "symbol_or_id")
    return joins.lookup_symbol(with_both, known, fallback=False)


@query("stocks_x_prices")
def stocks_x_prices(spark, sf_dir):
    return rounded(joins.stocks_with_prices(m.stocks(spark, sf_dir), m.prices(spark, sf_dir)))


@query("symbol_maps")
def symbol_maps(spark, sf_dir):
    return joins.symbol_maps(m.stocks(spark, sf_dir))


# --- features --------------------------------------------------------------------------------

for _name in schemas.FEATURE_COLUMNS:
    query(_name)(lambda spark, sf_dir, column=_name: rounded(
        m.features(spark, sf_dir).select("stock_id", "trade_date", column)))


@query("compute_features")
def compute_features(spark, sf_dir):
    return rounded(m.features(spark, sf_dir))


@query("compute_features_for_stock")
def compute_features_for_stock(spark, sf_dir):
    return rounded(feat.compute_features_for_stock(m.prices(spark, sf_dir), ONE_STOCK))


@query("refreshed_features")
def refreshed_features(spark, sf_dir):
    return rounded(feat.refreshed_features(feat.price_series(m.prices(spark, sf_dir)), CUT))


# --- capital flow ----------------------------------------------------------------------------

@query("typical_price")
def typical_price(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select("stock_id", "trade_date", "typical_price"))


@query("raw_money_flow")
def raw_money_flow(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select("stock_id", "trade_date", "raw_money_flow"), 2)


@query("flow_direction")
def flow_direction(spark, sf_dir):
    return _flows(spark, sf_dir).select("stock_id", "trade_date", "flow_direction")


@query("inflow_outflow")
def inflow_outflow(spark, sf_dir):
    return rounded(
        _flows(spark, sf_dir).select("stock_id", "trade_date", "inflow", "outflow"), 2)


@query("rolling_flow_14")
def rolling_flow_14(spark, sf_dir):
    flows = flow.compute_capital_flow(
        feat.price_series(m.prices(spark, sf_dir)), rolling_sums=True)
    return rounded(flows.select("stock_id", "trade_date", "inflow_14", "outflow_14"), 2)


@query("mfi_14")
def mfi_14(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select("stock_id", "trade_date", "mfi_14"))


@query("net_flow")
def net_flow(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select("stock_id", "trade_date", "net_flow"), 2)


@query("cumulative_flow")
def cumulative_flow(spark, sf_dir):
    return rounded(_flows(spark, sf_dir).select("stock_id", "trade_date", "cumulative_flow"), 2)


@query("compute_capital_flow")
def compute_capital_flow(spark, sf_dir):
    money = ("raw_money_flow", "inflow", "outflow", "net_flow")
    flows = rounded(rounded(_flows(spark, sf_dir), 2, money), 6, ("typical_price", "mfi_14"))
    return rounded(flows, 2, ("cumulative_flow",))


# --- dashboard -------------------------------------------------------------------------------

@query("market_overview")
def market_overview(spark, sf_dir):
    return rounded(_overview(spark, sf_dir))


for _name, _view in {
    "kpi_cards": dashboard.kpi_cards, "heatmap_series": dashboard.heatmap_series,
    "volume_comparison": dashboard.volume_comparison, "summary_table": dashboard.summary_table,
}.items():
    query(_name)(lambda spark, sf_dir, view=_view: rounded(view(_overview(spark, sf_dir))))


@query("period_kpis")
def period_kpis(spark, sf_dir):
    return rounded(dashboard.period_kpis_of(m.prices(spark, sf_dir), dashboard.LOOKBACK_DAYS, AS_OF))


@query("candle_colors")
def candle_colors(spark, sf_dir):
    return m.prices(spark, sf_dir).select(
        "stock_id", "trade_date", dashboard.candle_color().alias("color"))


@query("indicator_colors")
def indicator_colors(spark, sf_dir):
    return dashboard.indicator_colors(m.features(spark, sf_dir))


@query("candles_with_ma")
def candles_with_ma(spark, sf_dir):
    prices = _stored_prices(spark, sf_dir)
    features = feat.compute_features(feat.price_series(prices))
    return rounded(dashboard.candles_with_ma(prices, features, 180, AS_OF))


@query("distinct_models")
def distinct_models(spark, sf_dir):
    return dashboard.distinct_models(m.naive_predictions(m.prices(spark, sf_dir)))


@query("latest_prediction")
def latest_prediction(spark, sf_dir):
    return rounded(dashboard.latest_prediction(m.naive_predictions(m.prices(spark, sf_dir))))


@query("prediction_accuracy")
def prediction_accuracy(spark, sf_dir):
    prices = _stored_prices(spark, sf_dir)
    return rounded(dashboard.prediction_accuracy(m.naive_predictions(prices), prices))


@query("prediction_history")
def prediction_history(spark, sf_dir):
    return dashboard.prediction_history(m.naive_predictions(m.prices(spark, sf_dir)))


@query("alert_summary")
def alert_summary(spark, sf_dir):
    return rounded(dashboard.alert_summary(
        m.naive_anomalies(m.prices(spark, sf_dir)), m.stocks(spark, sf_dir)))


@query("recent_anomalies")
def recent_anomalies(spark, sf_dir):
    return dashboard.recent_anomalies(m.naive_anomalies(m.prices(spark, sf_dir)))


@query("score_timeline")
def score_timeline(spark, sf_dir):
    return rounded(dashboard.score_timeline(m.naive_anomalies(m.prices(spark, sf_dir))))


@query("flow_kpis")
def flow_kpis(spark, sf_dir):
    return rounded(rounded(flow.flow_kpis(_flows(spark, sf_dir)), 6, ("mfi_latest",)), 2,
                   ("total_inflow", "total_outflow", "net_total"))


@query("mfi_signal")
def mfi_signal(spark, sf_dir):
    value = F.coalesce("mfi_14", F.lit(flow.NEUTRAL_MFI))
    return _flows(spark, sf_dir).select(
        "stock_id", "trade_date", flow.mfi_signal(value).alias("signal"))


@query("net_flow_sign")
def net_flow_sign(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "stock_id", "trade_date", flow.net_flow_sign("net_flow").alias("sign"))


@query("range_slice")
def range_slice(spark, sf_dir):
    return dashboard.range_extents(_stored_prices(spark, sf_dir), ("1m", "3m", "6m", "ytd", "1y", "all"))


@query("flow_series")
def flow_series(spark, sf_dir):
    series = flow.flow_series(written_once(_flows(spark, sf_dir)))
    return rounded(rounded(series, 2, ("net_flow",)), 2, ("cumulative_flow",))


# --- union and scalars -----------------------------------------------------------------------

@query("union_predictions")
def union_predictions(spark, sf_dir):
    rows = written_once(m.naive_predictions(m.prices(spark, sf_dir)))
    return rounded(models.union_predictions(
        *[rows.where(F.col("model_name") == n) for n in training.MODEL_NAMES]))


@query("next_business_day")
def next_business_day(spark, sf_dir):
    return m.trades(spark, sf_dir).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("trades")).withColumn(
        "next_day", S.next_business_day("trade_date"))


@query("round2")
def round2(spark, sf_dir):
    return _flows(spark, sf_dir).select(
        "stock_id", "trade_date", F.round("mfi_14", 2).alias("mfi"))


@query("fmt_money")
def fmt_money(spark, sf_dir):
    return m.prices(spark, sf_dir).select(
        "stock_id", "trade_date", S.money("close_price").alias("close"),
        S.whole_money(F.col("close_price") * F.col("volume")).alias("turnover"))


@query("fmt_signed")
def fmt_signed(spark, sf_dir):
    return m.features(spark, sf_dir).select(
        "stock_id", "trade_date", S.signed("price_difference").alias("change"),
        S.signed_percent(F.col("daily_return") * 100).alias("percent"),
        S.delta_text("price_difference", F.col("daily_return") * 100).alias("delta"))


@query("fmt_count")
def fmt_count(spark, sf_dir):
    return m.prices(spark, sf_dir).select(
        "stock_id", "trade_date", S.grouped_count(F.col("volume") * 1000).alias("volume"))


@query("fmt_date")
def fmt_date(spark, sf_dir):
    return m.prices(spark, sf_dir).select(
        "stock_id", "trade_date", S.day_text("trade_date").alias("day"))


@query("title_model")
def title_model(spark, sf_dir):
    return m.naive_predictions(m.prices(spark, sf_dir)).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("rows")).withColumn("title", S.model_title("model_name"))


@query("stock_label")
def stock_label(spark, sf_dir):
    label = S.stock_label("symbol", "company_name")
    return m.stocks(spark, sf_dir).withColumn("label", label).withColumn(
        "label_symbol", S.label_symbol("label"))


@query("fmt_score")
def fmt_score(spark, sf_dir):
    return m.features(spark, sf_dir).select(
        "stock_id", "trade_date",
        *[S.decimals("volatility", n).alias(f"score_{n}") for n in (1, 3, 4)])


@query("issue_text")
def issue_text(spark, sf_dir):
    counts = quality.quality_counts(_clean(spark, sf_dir))
    return counts.withColumn("issue", F.explode(quality.issue_texts())).groupBy("issue").agg(
        F.count(F.lit(1)).alias("symbols"))


@query("epoch_to_date")
def epoch_to_date(spark, sf_dir):
    return m.table(spark, sf_dir, "events").select(
        "event_id", S.epoch_to_date(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"),
        S.date_to_epoch(F.to_date("ts")).alias("day_seconds"))


@query("math_scalars")
def math_scalars(spark, sf_dir):
    p = m.prices(spark, sf_dir)
    move = F.col("close_price") - F.col("open_price")
    return rounded(p.select(
        "stock_id", "trade_date", F.sqrt("close_price").alias("root"), F.abs(move).alias("move"),
        F.greatest("open_price", "close_price").alias("upper"),
        F.least("open_price", "close_price").alias("lower"),
        S.ratio(move, F.col("high_price") - F.col("low_price")).alias("share")))


# --- models ----------------------------------------------------------------------------------

@query("training_frame")
def training_frame(spark, sf_dir):
    return rounded(training.training_frame(_joined(spark, sf_dir)))


@query("chrono_split")
def chrono_split(spark, sf_dir):
    return _split(spark, sf_dir).select(
        "stock_id", "trade_date", "position", "total", "is_train", "fold")


@query("train_linear")
def train_linear(spark, sf_dir):
    fitted = linear.fit_linear(_stored_split(spark, sf_dir).where("is_train"))
    names = [F.col("coefficients")[i].alias(f"w_{c}")
             for i, c in enumerate(schemas.FEATURE_COLUMNS)]
    return fitted.select("stock_id", *names, "intercept")


@query("train_linear_fitted")
def train_linear_fitted(spark, sf_dir):
    """What the fit on all six features makes of its training rows, to a ten-thousandth."""
    train = _stored_split(spark, sf_dir).where("is_train")
    scored = models.train_linear(train).predict(train, "fitted")
    return rounded(scored.select("stock_id", "trade_date", "fitted"), 4)


@query("train_linear_averages")
def train_linear_averages(spark, sf_dir):
    two = ("ma_7", "ma_30")
    fitted = linear.fit_linear(_stored_split(spark, sf_dir).where("is_train"), two)
    return rounded(fitted.select(
        "stock_id", F.col("coefficients")[0].alias("w_ma_7"),
        F.col("coefficients")[1].alias("w_ma_30"), "intercept"))


@query("train_boosted")
def train_boosted(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    _, metrics = models.train_models(split, ("xgboost",))
    return metrics


@query("train_stacking")
def train_stacking(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    _, metrics = models.train_models(split, ("stacking",))
    return metrics


@query("train_forest")
def train_forest(spark, sf_dir):
    split = _stored_split(spark, sf_dir)
    _, metrics = models.train_models(split, ("random_forest",), models.WITH_FOREST)
    return metrics


@query("train_boosted_round")
def train_boosted_round(spark, sf_dir):
    """One round of trees of one level on the two averages: what each training row is predicted."""
    train = _stored_split(spark, sf_dir).where("is_train")
    bases = boosting.mean_targets(train)
    grown = trees.fit_trees(train, trees.Boosting(1, 1, boosting.STEP), bases, ("ma_7", "ma_30"))
    scored = trees.predict_trees(train, grown, bases, ("ma_7", "ma_30"))
    return rounded(scored.select("stock_id", "trade_date", "predicted"))


@query("train_stacking_ridge")
def train_stacking_ridge(spark, sf_dir):
    ridge = linear.fit_ridge(_stored_split(spark, sf_dir).where("is_train"), ("ma_7", "ma_30"))
    return rounded(ridge.select(
        "stock_id", "alpha", F.col("coefficients")[0].alias("w_ma_7"),
        F.col("coefficients")[1].alias("w_ma_30"), "intercept"))


def _naive_scores(spark, sf_dir) -> DataFrame:
    """Held-out rows scored by the close and its averages, under the model names."""
    test = _split(spark, sf_dir).where(~F.col("is_train"))
    scores = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model_name"), F.col(c).alias("predicted"))
        for n, c in zip(training.MODEL_NAMES, ("close_price", "ma_7", "ma_30"))]))
    return test.select("stock_id", "target", scores.alias("s")).select(
        "stock_id", "target", "s.*")


@query("evaluate")
def evaluate(spark, sf_dir):
    return rounded(training.evaluate(_naive_scores(spark, sf_dir)))


@query("train_report")
def train_report(spark, sf_dir):
    joined = written_once(_joined(spark, sf_dir))
    return training.train_report(
        joined, training.training_split(joined),
        models=(*training.MODEL_NAMES, "random_forest"))


@query("compare_models")
def compare_models(spark, sf_dir):
    metrics = training.evaluate(_naive_scores(spark, sf_dir))
    return rounded(training.compare_models(
        joins.lookup_symbol(metrics, m.stocks(spark, sf_dir))))


@query("latest_features")
def latest_features(spark, sf_dir):
    return rounded(training.latest_features(m.features(spark, sf_dir)))


@query("predict_next_close")
def predict_next_close(spark, sf_dir):
    weights = F.array(*[F.lit(w) for w in (10.0, 0.1, 5.0, 0.5, 0.4, 0.001)])
    fixed = models.LinearModel(m.stocks(spark, sf_dir).select(
        "stock_id", weights.alias("coefficients"),
        (F.col("stock_id") * 1.0).alias("intercept")))
    latest = training.latest_features(m.features(spark, sf_dir))
    return models.predict_next_close(latest, fixed, "linear_regression")


# --- anomalies -------------------------------------------------------------------------------

@query("volume_change_pct")
def volume_change_pct(spark, sf_dir):
    return rounded(anomaly.volume_change(_anomaly_joined(spark, sf_dir)).select(
        "stock_id", "trade_date", "volume_change_pct"))


@query("anomaly_frame")
def anomaly_frame(spark, sf_dir):
    return rounded(anomaly.anomaly_frame(_anomaly_joined(spark, sf_dir)))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    return rounded(anomaly.isolation_forest(
        anomaly.anomaly_frame(_anomaly_joined(spark, sf_dir))))


@query("anomaly_flags")
def anomaly_flags(spark, sf_dir):
    frame = anomaly.anomaly_frame(_anomaly_joined(spark, sf_dir))
    raw = frame.select("stock_id", "trade_date",
                       (-F.abs("daily_return") - F.col("volatility")).alias("raw"))
    return rounded(anomaly.anomaly_flags(written_once(raw)))


@query("detect_anomalies")
def detect_anomalies(spark, sf_dir):
    found = anomaly.detect_anomalies(_anomaly_joined(spark, sf_dir))
    return found.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anomaly_flag").alias("anomalies"))


# --- jobs and streaming ----------------------------------------------------------------------

@query("job_backfill")
def job_backfill(spark, sf_dir):
    store = jobs.Store(scratch_path(spark, "backfill"))
    bars = written_once(m.symbol_bars(spark, sf_dir))
    brands = m.stocks(spark, sf_dir).select("symbol", "company_name")
    return rounded(jobs.backfill(
        spark, store, candle_payloads(bars), brands, loaded_at=m.LOADED_AT))


def _stored(spark, sf_dir) -> tuple[jobs.Store, DataFrame, dt.date]:
    """A store filled up to the day before the last, and the feed and date of the last day."""
    store = jobs.Store(scratch_path(spark, "market"))
    bars = written_once(m.symbol_bars(spark, sf_dir))
    brands = m.stocks(spark, sf_dir).select("symbol", "company_name")
    last = bars.agg(F.max("trade_date")).first()[0]
    early = bars.where(F.col("trade_date") < F.lit(last))
    jobs.backfill(spark, store, candle_payloads(early), brands, loaded_at=m.LOADED_AT)
    later = bars.where(F.col("trade_date") >= F.lit(last)).select(
        F.lit(0).cast("bigint").alias("seq"), "symbol", F.col("trade_date").alias("date"),
        *schemas.OHLCV)
    return store, later, last


@query("job_weekly_train")
def job_weekly_train(spark, sf_dir):
    store = jobs.Store(scratch_path(spark, "market"))
    bars = written_once(m.symbol_bars(spark, sf_dir))
    brands = m.stocks(spark, sf_dir).select("symbol", "company_name")
    jobs.backfill(spark, store, candle_payloads(bars), brands, loaded_at=m.LOADED_AT)
    _, best = jobs.weekly_training(spark, store)
    return best


@query("job_daily")
def job_daily(spark, sf_dir):
    """The last day, on a store that holds all days before it, with all models and trees."""
    store, later, last = _stored(spark, sf_dir)
    jobs.weekly_training(spark, store)
    predictions, anomalies = jobs.daily_update(spark, store, later, last, loaded_at=m.LOADED_AT)
    predicted = predictions.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_distinct("model_name").alias("models"),
        F.min("prediction_date").alias("first_day"), F.max("prediction_date").alias("last_day"))
    scored = anomalies.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if("anomaly_flag").alias("anomalies"))
    return predicted.join(scored, "stock_id", "full")


def _stream(spark: SparkSession, sf_dir: str, bars: str, features: str | None = None) -> None:
    schema = m.table(spark, sf_dir, "events").schema
    ticks = stream.read_ticks(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema)
    stream.stream_upsert(ticks, bars, scratch_path(spark, "stream"), features).awaitTermination()


@query("stream_bars")
def stream_bars(spark, sf_dir):
    path = scratch_path(spark, "bars")
    _stream(spark, sf_dir, path)
    return rounded(sink.read_table(spark, path, stream.BAR_SCHEMA))


@query("stream_upsert")
def stream_upsert(spark, sf_dir):
    path = scratch_path(spark, "bars")
    _stream(spark, sf_dir, path, f"{path}-features")
    return rounded(sink.read_table(spark, f"{path}-features", stream.FEATURE_SCHEMA))
