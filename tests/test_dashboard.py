import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import scalars as S
from tickloom.operators import capital_flow as flow, dashboard

DAY = dt.date(2024, 1, 31)
PRICES = ("stock_id int, trade_date date, open_price double, high_price double, "
          "low_price double, close_price double, volume bigint")


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(1, DAY - dt.timedelta(days=400 - 50 * i), 1.0, 10.0 + i, 0.5, 2.0 + i, 1000 * i)
            for i in range(9)]
    return spark.createDataFrame([*rows, (2, DAY, 1.0, 2.0, 0.5, 1.5, 10)], PRICES)


def test_overview_needs_two_bars(spark, prices):
    stocks = spark.createDataFrame([(1, "A", "a"), (2, "B", "b")], schemas.STOCKS)
    overview = dashboard.market_overview(prices, stocks)
    row = overview.collect()
    assert len(row) == 1
    assert (row[0].symbol, row[0].close, row[0].change, row[0].volume) == ("A", 10.0, 1.0, 8000)
    assert row[0].change_pct == pytest.approx(100 / 9)
    card = dashboard.kpi_cards(overview).collect()[0]
    assert (card.value, card.delta) == ("$10.00", "+1.00 (+11.11%)")
    assert dashboard.volume_comparison(overview).collect()[0].label == "8,000"
    assert dashboard.heatmap_series(overview).collect()[0].label == "+11.11%"
    assert dashboard.summary_table(overview).collect()[0].trade_date == "2024-01-31"


def test_period_kpis(prices):
    kpis = {r.stock_id: r for r in dashboard.period_kpis(prices, 180, DAY).collect()}
    one = kpis[1]
    assert (one.first_close, one.latest_close, one.period_high, one.period_low) == (
        7.0, 10.0, 18.0, 0.5)
    assert one.period_change_pct == pytest.approx(300 / 7)


def test_range_buttons(prices):
    rows = {b: dashboard.range_slice(prices.where("stock_id = 1"), b).count()
            for b in ("1m", "3m", "6m", "ytd", "1y", "all")}
    assert rows == {"1m": 1, "3m": 2, "6m": 4, "ytd": 1, "1y": 8, "all": 9}


def test_null_colors(spark):
    features = spark.createDataFrame(
        [(1, DAY, None, None), (2, DAY, 0.0, -1.0)],
        "stock_id int, trade_date date, daily_return double, capital_flow_indicator double")
    got = {r.stock_id: (r.return_color, r.flow_color)
           for r in dashboard.indicator_colors(features).collect()}
    assert got == {1: ("down", "up"), 2: ("up", "down")}


@pytest.mark.parametrize("mfi, shown, signal", (
    (None, 50.0, "Neutral"), (80.0, 80.0, "Neutral"), (80.1, 80.1, "Overbought"),
    (20.0, 20.0, "Neutral"), (19.9, 19.9, "Oversold")))
def test_mfi_display(spark, mfi, shown, signal):
    flows = spark.createDataFrame(
        [(1, DAY - dt.timedelta(days=1), 5.0, 1.0, 33.0, 4.0, 4.0),
         (1, DAY, 0.0, 4.0, mfi, -4.0, 0.0)],
        "stock_id int, trade_date date, inflow double, outflow double, mfi_14 double, "
        "net_flow double, cumulative_flow double")
    row = flow.flow_kpis(flows).select(
        "*", flow.mfi_signal().alias("signal"), flow.net_flow_sign().alias("sign")).collect()[0]
    assert (row.mfi_latest, row.signal, row.net_total, row.sign) == (
        shown, signal, 0.0, "Negative")
    assert {r.trend for r in flow.flow_series(flows).collect()} == {"up"}


def test_predictions(spark, prices):
    rows = [(1, DAY + dt.timedelta(days=i), 10.0 + i, "linear_regression",
             dt.datetime(2024, 1, 1)) for i in range(60)]
    predictions = spark.createDataFrame(rows, schemas.PREDICTIONS)
    assert dashboard.latest_prediction(predictions).collect()[0].model_title == \
        "Linear Regression"
    assert dashboard.prediction_history(predictions).count() == 50
    accuracy = dashboard.prediction_accuracy(predictions, prices).collect()
    assert [(r.mae, r.predictions) for r in accuracy] == [(0.0, 1)]
    assert [r.model_name for r in dashboard.distinct_models(predictions).collect()] == [
        "linear_regression"]


def test_alerts(spark):
    stocks = spark.createDataFrame([(1, "A", "a")], schemas.STOCKS)
    rows = [(s, DAY - dt.timedelta(days=i), -0.1 * i, i > 0, "isolation_forest", None)
            for s in (1, 2) for i in range(30)]
    anomalies = spark.createDataFrame(rows, schemas.ANOMALIES)
    got = {r.stock_id: (r.symbol, r.anomaly_count, r.latest_date)
           for r in dashboard.alert_summary(anomalies, stocks).collect()}
    last = DAY - dt.timedelta(days=1)
    assert got == {1: ("A", 29, last), 2: (None, 29, last)}
    recent = dashboard.recent_anomalies(anomalies.where("stock_id = 1"))
    assert recent.count() == 20
    assert recent.orderBy(F.desc("trade_date")).first().anomaly_score == "-0.1000"
    assert dashboard.score_timeline(anomalies).where("below_boundary").count() == 58


def test_labels(spark):
    row = spark.range(1).select(
        S.stock_label(F.lit("A"), F.lit("A — B")).alias("label"),
        S.delta_text(F.lit(-1.0), F.lit(2.0)).alias("delta"),
        S.whole_money(F.lit(1234567.8)).alias("whole"),
        S.known(F.lit(float("inf"))).alias("infinite")).withColumn(
        "symbol", S.label_symbol("label")).collect()[0]
    assert tuple(row) == ("A — A — B", "-1.00 (+2.00%)", "$1,234,568", None, "A")
