import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BAR_SCHEMA, START, random_bars
from tickloom.functions.scalars import next_business_day
from tickloom.operators import linear, models, training
from tickloom.operators.features import compute_features
from tickloom.operators.joins import join_training
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import scratch_path, written_once

FAST = {"rounds": 2, "depth": 2}


@pytest.fixture(scope="module")
def joined(spark):
    bars = spark.createDataFrame(random_bars(11, (140, 100, 59, 60)), BAR_SCHEMA)
    prices = bars.withColumnRenamed("close", "close_price")
    return written_once(join_training(prices, compute_features(bars)))


@pytest.fixture(scope="module")
def split(joined):
    return written_once(training.chrono_split(training.training_frame(joined)))


def arrays(split, stock_id, columns, target="target"):
    frame = split.where(f"stock_id = {stock_id} and is_train").orderBy("trade_date").toPandas()
    return frame[list(columns)].to_numpy(float), frame[target].to_numpy(float), frame


def test_row_guard_and_split(split):
    sizes = {r.stock_id: (r.train, r.test) for r in split.groupBy("stock_id").agg(
        F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"),
    ).collect()}
    # One row has no return and one has no next close.
    assert sizes == {1: (110, 28), 2: (78, 20), 4: (46, 12)}


def test_eleven_rows_split_into_eight_and_three(spark):
    frame = spark.range(11).select(
        F.lit(1).alias("stock_id"), F.date_add(F.lit(START), F.col("id").cast("int"))
        .alias("trade_date"))
    assert training.chrono_split(frame).where("is_train").count() == 8


def test_least_squares(split):
    fitted = {r.stock_id: r for r in linear.fit_linear(split.where("is_train")).collect()}
    for stock_id in (1, 2, 4):
        x, y, _ = arrays(split, stock_id, FEATURE_COLUMNS)
        design = np.column_stack([x, np.ones(len(x))])
        want = np.linalg.lstsq(design, y, rcond=None)[0]
        got = [*fitted[stock_id].coefficients, fitted[stock_id].intercept]
        np.testing.assert_allclose(design @ got, design @ want, rtol=1e-7)
        np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-6)


def test_constant_and_collinear_columns(spark):
    rows = spark.range(50).select(
        F.lit(1).alias("stock_id"), (F.col("id") * 1.0).alias("a"), F.lit(3.0).alias("b"),
        (F.col("id") * 2.0).alias("c"), (F.col("id") * 5.0 + 7).alias("target"))
    got = linear.fit_linear(rows, ("a", "b", "c")).collect()[0]
    a, b, c = got.coefficients
    assert b == 0.0 and a + 2 * c == pytest.approx(5.0)
    assert got.intercept == pytest.approx(7.0)


def test_fits_without_a_fold(split):
    train = split.where("is_train")
    got = {(r.stock_id, r.fold): r for r in linear.fit_linear_without_folds(train).collect()}
    assert len(got) == 3 * training.FOLDS
    for fold in range(training.FOLDS):
        x, y, frame = arrays(split, 1, FEATURE_COLUMNS)
        keep = (frame["fold"] != fold).to_numpy()
        design = np.column_stack([x, np.ones(len(x))])
        want = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
        mine = got[(1, fold)]
        np.testing.assert_allclose(
            design @ [*mine.coefficients, mine.intercept], design @ want, rtol=1e-6)


def test_ridge_penalty_by_leaving_one_out(split):
    two = ("ma_7", "ma_30")
    fitted = {r.stock_id: r for r in linear.fit_ridge(split.where("is_train"), two).collect()}
    for stock_id in (1, 2, 4):
        x, y, _ = arrays(split, stock_id, two)

        def fit(x, y, alpha):
            xm, ym = x.mean(axis=0), y.mean()
            w = np.linalg.solve(
                (x - xm).T @ (x - xm) + alpha * np.eye(2), (x - xm).T @ (y - ym))
            return w, ym - w @ xm

        def loo(alpha):
            errors = []
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                w, b = fit(x[keep], y[keep], alpha)
                errors.append((y[i] - x[i] @ w - b) ** 2)
            return sum(errors)

        # Leaving a row out also moves the means; the closed form accounts for that.
        best = min(linear.ALPHAS, key=loo)
        w, b = fit(x, y, best)
        assert fitted[stock_id].alpha == best
        np.testing.assert_allclose(
            [*fitted[stock_id].coefficients, fitted[stock_id].intercept], [*w, b], rtol=1e-7)


def metrics_of(spark, pairs):
    rows = [(1, "m", float(t), float(p)) for t, p in pairs]
    return training.evaluate(spark.createDataFrame(
        rows, "stock_id int, model_name string, target double, predicted double")).collect()[0]


def test_metric_edges(spark):
    assert metrics_of(spark, [(5, 5), (5, 5)]).r2 == 1.0
    assert metrics_of(spark, [(5, 5), (5, 6)]).r2 == 0.0
    assert metrics_of(spark, [(5, 6)]).r2 is None
    plain = metrics_of(spark, [(1, 1), (2, 3), (3, 3)])
    assert (plain.rmse, plain.mae, plain.r2) == (
        pytest.approx((1 / 3) ** 0.5), pytest.approx(1 / 3), pytest.approx(0.5))


def test_best_model(spark):
    names = training.MODEL_NAMES
    rows = [("A", names[0], 0.5), ("A", names[1], 0.5), ("A", names[2], 0.4),
            ("B", names[0], 0.1), ("B", names[2], 0.2), ("C", names[1], 0.9),
            ("D", names[0], None), ("D", names[1], -3.0)]
    got = training.compare_models(
        spark.createDataFrame(rows, "symbol string, model_name string, r2 double"))
    assert {r.symbol: r.best_model for r in got.collect()} == {
        "A": names[0], "B": names[2], "D": names[1]}


def test_report_lists_skips(joined, split):
    report = training.train_report(joined, split, models=("linear_regression", "other"))
    rows = {(r.stock_id, r.model_name): r for r in report.collect()}
    assert rows[(3, "linear_regression")].reason == "Insufficient data: 59 rows (need ≥60)"
    assert rows[(4, "linear_regression")].status == "trained"
    assert rows[(4, "linear_regression")].train_size == 46
    assert rows[(1, "other")].reason == "Unknown model type: other"
    with pytest.raises(ValueError):
        models.fit("other", split)


def test_all_models_train_save_and_predict(spark, split):
    fitted, metrics = models.train_models(split, **FAST)
    assert metrics.count() == 9
    folder = scratch_path(spark, "models")
    latest = training.latest_features(split.drop("target"))
    for name, model in fitted.items():
        models.save_model(model, folder, name)
        again = models.load_model(spark, folder, name)
        one, two = (sorted(tuple(r) for r in models.predict_next_close(latest, m, name).collect())
                    for m in (model, again))
        assert one == two and len(one) == 3 * training.LATEST_ROWS
    assert models.load_model(spark, scratch_path(spark, "none"), "linear_regression") is None
    assert models.load_model(spark, scratch_path(spark, "none"), "xgboost") is None


def test_skipped_instruments_keep_their_model(spark, split):
    folder = scratch_path(spark, "weeks")
    train = split.where("is_train")
    for name in ("linear_regression", "xgboost"):
        first = models.fit(name, train, **FAST)
        second = models.fit(name, split.where("stock_id = 2"), **FAST)
        models.save_model(first, folder, name)
        models.save_model(second, folder, name)
        found = {r.stock_id: r.version for r in models.newest_versions(spark, folder, name).collect()}
        assert found == {1: 1, 2: 2, 4: 1}
        again = models.load_model(spark, folder, name)

        def values(model, where):
            return sorted(r.predicted for r in model.predict(split.where(where)).collect())

        assert values(again, "stock_id <> 2") == values(first, "stock_id <> 2")
        assert values(again, "stock_id = 2") == values(second, "stock_id = 2") != values(first, "stock_id = 2")
        # Tables of a version that is not listed do not count.
        model = models.fit(name, split.where("stock_id = 4"), **FAST)
        for part, table in models._parts(model).items():
            table.write.parquet(f"{folder}/{name}/{part}/version=3")
        assert values(models.load_model(spark, folder, name), "stock_id = 4") == values(first, "stock_id = 4")


def test_boosting_beats_the_mean_on_its_training_rows(split):
    train = split.where("is_train")
    model = models.fit("xgboost", train, rounds=10, depth=4)
    scored = model.predict(train).withColumn("model_name", F.lit("xgboost"))
    pooled = training.evaluate(scored.withColumn("stock_id", F.lit(0))).collect()[0]
    assert pooled.r2 > 0


def test_rows_with_missing_features_are_not_predicted(spark, split):
    model = models.fit("linear_regression", split.where("is_train"))
    latest = training.latest_features(split.drop("target"))
    holes = latest.withColumn("volatility", F.when(F.col("stock_id") != 1, F.col("volatility")))
    predicted = models.predict_next_close(holes, model, "linear_regression")
    assert predicted.where("stock_id = 1").count() == 0
    assert predicted.count() == 2 * training.LATEST_ROWS


def test_next_business_day(spark):
    days = spark.createDataFrame(
        [(dt.date(2024, 1, d),) for d in (4, 5, 6, 7)], "d date")
    got = [r[0] for r in days.select(next_business_day("d")).collect()]
    assert got == [dt.date(2024, 1, 5)] + [dt.date(2024, 1, 8)] * 3
