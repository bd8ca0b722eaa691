import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BAR_SCHEMA, random_bars
from tickloom.operators import boosting, models, training, trees
from tickloom.operators.features import compute_features
from tickloom.operators.joins import join_training
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import written_once


@pytest.fixture(scope="module")
def split(spark):
    bars = spark.createDataFrame(random_bars(12, (170, 90)), BAR_SCHEMA)
    prices = bars.withColumnRenamed("close", "close_price")
    joined = join_training(prices, compute_features(bars))
    return written_once(training.chrono_split(training.training_frame(joined)))


@pytest.fixture(scope="module")
def train(split):
    return written_once(split.where("is_train"))


def arrays(train, stock_id):
    frame = train.where(f"stock_id = {stock_id}").orderBy("trade_date").toPandas()
    x = frame[list(FEATURE_COLUMNS)].to_numpy(float)
    days = (frame["trade_date"].to_numpy().astype("datetime64[D]")).astype(np.int32)
    return x, frame["target"].to_numpy(float), frame["fold"].to_numpy(int), days


def cuts_of(column):
    """Quantiles at multiples of 1/256, as elements of the sorted column."""
    ordered = np.sort(column)
    return np.unique(ordered[[int(np.ceil(k / 256 * len(ordered))) - 1 for k in range(1, 256)]])


def grow(x, g, h, cuts, depth, penalty, rows):
    """A tree by trying every cut on the values themselves; returns a function of a row."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    leaf = -g[rows].sum() / (h[rows].sum() + penalty)
    best = (1e-6, None, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in cuts[f]:
            low, high = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
            if h[low].sum() < 1 or h[high].sum() < 1:
                continue
            gain = score(low) + score(high) - score(rows)
            if gain > best[0] * (1 + trees.TIE):
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return lambda row: leaf
    low, high = (grow(x, g, h, cuts, depth - 1, penalty, rows & m) for m in (x[:, f] <= cut, x[:, f] > cut))
    return lambda row: (low if row[f] <= cut else high)(row)


def boosted(x, y, kept, rounds, depth, step):
    cuts = [cuts_of(x[:, f]) for f in range(x.shape[1])]
    predicted = np.full(len(y), y[kept].mean())
    for _ in range(rounds):
        tree = grow(x, (predicted - y) * kept, kept.astype(float), cuts, depth, 1.0, kept)
        predicted = predicted + step * np.array([tree(row) for row in x])
    return predicted


def predicted_by_day(scored, stock_id, column="predicted"):
    return np.array([r[column] for r in scored.where(f"stock_id = {stock_id}").orderBy("trade_date").collect()])


@pytest.mark.parametrize("block_rows", [trees.BLOCK_ROWS, 40])
def test_boosting_equals_plain_numpy(train, block_rows):
    # With 40 rows a block, both instruments are spread over blocks and grow in step.
    folded = boosting.fit_folds(train, rounds=3, depth=2, block_rows=block_rows)
    whole = written_once(folded.whole().predict(train))
    outside = written_once(folded.predict_out_of_fold(train, "predicted"))
    for stock_id in (1, 2):
        x, y, fold, _ = arrays(train, stock_id)
        everything = np.ones(len(y), bool)
        np.testing.assert_allclose(
            predicted_by_day(whole, stock_id), boosted(x, y, everything, 3, 2, 0.3), rtol=1e-9)
        # Out-of-fold predictions are those of separate fits, on the cuts of all rows.
        want = np.zeros(len(y))
        for f in range(training.FOLDS):
            want[fold == f] = boosted(x, y, fold != f, 3, 2, 0.3)[fold == f]
        np.testing.assert_allclose(predicted_by_day(outside, stock_id), want, rtol=1e-9)


@pytest.mark.parametrize("block_rows", [trees.BLOCK_ROWS, 40])
def test_forest_equals_plain_numpy(train, block_rows):
    scored = written_once(boosting.fit_forest(train, trees=4, depth=3, block_rows=block_rows).predict(train))
    for stock_id in (1, 2):
        x, y, _, days = arrays(train, stock_id)
        cuts = [cuts_of(x[:, f]) for f in range(x.shape[1])]
        total = np.zeros(len(y))
        for number in range(4):
            weight = trees.poisson_weights(boosting.SEED, stock_id, number, days)
            tree = grow(x, (y.mean() - y) * weight, weight, cuts, 3, 0.0, weight > 0)
            total += np.array([y.mean() + tree(row) for row in x])
        np.testing.assert_allclose(predicted_by_day(scored, stock_id), total / 4, rtol=1e-9)


def test_bootstrap_weights():
    days = np.arange(40_000, dtype=np.int32)
    one, two = (trees.poisson_weights(42, 7, t, days) for t in (0, 1))
    assert one.mean() == pytest.approx(1, abs=0.02) and one.var() == pytest.approx(1, abs=0.04)
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.02
    assert (one[:500] == trees.poisson_weights(42, 7, 0, days[:500])).all()


def test_predictions_of_a_long_series_are_spread(train):
    model = boosting.fit_boosted(train, rounds=2, depth=2)
    one = trees.predict_trees(train, model.trees, model.bases)
    spread = trees.predict_trees(train, model.trees, model.bases, chunk_rows=10)
    for stock_id in (1, 2):
        assert (predicted_by_day(one, stock_id) == predicted_by_day(spread, stock_id)).all()


def test_edges(spark, train):
    model = boosting.fit_boosted(train, rounds=1, depth=1)
    # Unknown instruments are dropped, missing values go right, no rows give none.
    other = train.withColumn("stock_id", F.col("stock_id") + 1)
    assert model.predict(other).select("stock_id").distinct().collect() == [(2,)]
    holes = train.withColumn("ma_7", F.lit(None).cast("double"))
    assert model.predict(holes).where("predicted IS NULL").count() == 0
    assert model.predict(train.limit(0)).count() == 0
    assert boosting.fit_boosted(train.limit(0), rounds=1, depth=1).trees.count() == 0
    # A constant target needs no split.
    flat = boosting.fit_boosted(train.withColumn("target", F.lit(5.0)), rounds=2, depth=2)
    assert [r[0] for r in flat.predict(train).select("predicted").distinct().collect()] == [5.0]


def test_registry(train):
    with pytest.raises(ValueError, match="Unknown model type: random_forest"):
        models.fit("random_forest", train)
    forest = models.fit("random_forest", train, models.WITH_FOREST, trees=2, depth=2)
    assert forest.trees.count() == 4
    with pytest.raises(ValueError, match="Unknown model type: other"):
        models.fit("other", train, models.WITH_FOREST)


@pytest.mark.parametrize("columns", [2, 3, 6])
def test_ridge_for_any_number_of_columns(train, columns):
    from tickloom.operators.linear import ALPHAS, fit_ridge

    names = FEATURE_COLUMNS[:columns]
    fitted = {r.stock_id: r for r in fit_ridge(train, names).collect()}
    for stock_id in (1, 2):
        x, y, _, _ = arrays(train, stock_id)
        x, centre = x[:, :columns], x[:, :columns].mean(axis=0)
        design = x - centre

        def solved(alpha):
            inverse = np.linalg.inv(design.T @ design + alpha * np.eye(columns))
            w = inverse @ design.T @ (y - y.mean())
            leverage = 1 / len(y) + np.einsum("ni,ij,nj->n", design, inverse, design)
            return w, (((y - y.mean() - design @ w) / (1 - leverage)) ** 2).sum()

        best = min(ALPHAS, key=lambda a: solved(a)[1])
        w, _ = solved(best)
        assert fitted[stock_id].alpha == best
        np.testing.assert_allclose(fitted[stock_id].coefficients, w, rtol=1e-6)
        assert fitted[stock_id].intercept == pytest.approx(y.mean() - centre @ w, rel=1e-6)
