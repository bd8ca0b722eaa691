import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BAR_SCHEMA, random_bars
from tickloom.operators import anomaly
from tickloom.operators.features import compute_features
from tickloom.operators.joins import join_anomaly_input
from tickloom.operators.quantiles import exact_quantile
from tickloom.session import written_once


@pytest.fixture(scope="module")
def frame(spark):
    bars = spark.createDataFrame(random_bars(21, (400, 35, 31, 30)), BAR_SCHEMA)
    prices = bars.withColumnRenamed("close", "close_price")
    return written_once(anomaly.anomaly_frame(
        join_anomaly_input(prices, compute_features(bars))))


def test_volume_change(spark):
    rows = [(1, row[1], 1.0, 2.0, 0.5, 1.5, v)
            for row, v in zip(random_bars(1, (5,)), (0, 5, 0, 0, 7))]
    prices = spark.createDataFrame(rows, BAR_SCHEMA)
    got = anomaly.volume_change(prices).orderBy("trade_date").collect()
    assert [r.volume_change_pct for r in got] == [None, None, -1.0, None, None]


def test_thirty_complete_rows_are_needed(frame):
    # The first row has no return, so thirty bars leave twenty-nine rows.
    assert {r.stock_id: r.rows for r in frame.select("stock_id", "rows").distinct().collect()} \
        == {1: 399, 2: 34, 3: 30}


@pytest.mark.parametrize("share", (0.0, 0.05, 0.5, 1.0))
def test_exact_quantile(spark, share):
    random = np.random.default_rng(3)
    groups = {1: random.normal(size=5000), 2: np.repeat([1.0, 2.0], 500), 3: np.array([4.0]),
              4: np.array([1.0, 2.0, 3.0, 4.0])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    got = exact_quantile(
        spark.createDataFrame(rows, "stock_id int, raw double"), "stock_id", "raw", share)
    for r in got.collect():
        assert r["quantile"] == pytest.approx(np.quantile(groups[r.stock_id], share), abs=1e-12)


def test_quantile_under_skew(spark):
    # One far outlier, a million equal values, values that lie ever closer together, and the widest range.
    rows = spark.range(1_000_000).select(F.lit(1).alias("stock_id"), F.lit(0.25).alias("raw")).unionByName(
        spark.createDataFrame(
            [(1, -1e9), (2, 1e300), (5, None), *[(2, float(v)) for v in range(1000)],
             *[(3, 2.0 ** -k) for k in range(60)], (4, -1.7e308), (4, 1.7e308), (4, 0.0)],
            "stock_id int, raw double"))
    for buckets in (64, 4096):
        if buckets == 64:
            rows_used = rows.where("stock_id in (2, 4)")
        else:
            rows_used = rows
        got = {r.stock_id: r["quantile"] for r in exact_quantile(
            rows_used, "stock_id", "raw", 0.05, buckets).collect()}
        if buckets > 64:
            assert got.pop(1) == 0.25
            assert got.pop(3) == pytest.approx(
                np.quantile([2.0 ** -k for k in range(60)], 0.05), rel=1e-12)
        assert got == {2: pytest.approx(50.0), 4: pytest.approx(-1.7e308 * 0.9)}


def test_flags_on_given_scores(spark):
    rows = [(1, None, float(v)) for v in (1, 2, 3, 4)]
    raw = spark.createDataFrame(rows, "stock_id int, trade_date date, raw double")
    flagged = anomaly.anomaly_flags(raw).where("anomaly_flag").collect()
    assert [r.anomaly_score for r in flagged] == [pytest.approx(-0.15)]


def test_samples_are_whole(frame):
    sizes = anomaly.sample_for_trees(frame, trees=20).groupBy("stock_id", "tree").count()
    counts = {(r.stock_id, r["count"]) for r in sizes.collect()}
    assert counts == {(1, 256), (2, 34), (3, 30)}
    assert sizes.count() == 60


def test_drawn_places(spark):
    sizes = spark.createDataFrame([(1, 10**12), (2, 300), (3, 5)], "stock_id int, total bigint")
    drawn = anomaly.drawn_places(sizes, trees=40).toPandas()
    for (stock_id, _), part in drawn.groupby(["stock_id", "tree"]):
        total = {1: 10**12, 2: 300, 3: 5}[stock_id]
        assert len(part) == min(256, total) == part["position"].nunique() == part["_rank"].max()
        assert part["position"].between(1, total).all()
    # All places come about equally often.
    counts = drawn[drawn["stock_id"] == 2]["position"].value_counts()
    assert len(counts) == 300 and counts.mean() == pytest.approx(40 * 256 / 300)


def plain_tree(points, random, depth):
    """A tree grown by recursion, right sides first."""
    def grown(level, part):
        low, high = part.min(axis=0), part.max(axis=0)
        varying = [f for f in range(part.shape[1]) if high[f] > low[f]]
        if level == depth or len(part) < 2 or not varying:
            return ("leaf", level + float(anomaly.average_path(len(part))))
        f = random.choice(varying)
        cut = random.uniform(low[f], high[f])
        left = part[:, f] <= cut
        right = grown(level + 1, part[~left])
        return ("split", f, cut, grown(level + 1, part[left]), right)

    return grown(0, points)


def test_forest_equals_plain_numpy(frame):
    trees = 6
    sample = anomaly.sample_for_trees(frame, trees=trees).toPandas()
    columns = list(anomaly.ANOMALY_FEATURES)
    whole = written_once(anomaly.score_forest(frame, anomaly.grow_forest(
        anomaly.sample_for_trees(frame, trees=trees)))).toPandas()
    for stock_id in (2, 3):
        rows = frame.where(f"stock_id = {stock_id}").toPandas()
        total, usual = np.zeros(len(rows)), 0.0
        for tree in range(trees):
            own = sample[(sample["stock_id"] == stock_id) & (sample["tree"] == tree)].sort_values("_rank")
            points = own[columns].to_numpy(float)
            random = np.random.default_rng([anomaly.SEED, stock_id, tree])
            root = plain_tree(points, random, int(np.ceil(np.log2(len(points)))))
            usual += float(anomaly.average_path(len(points)))
            for i, x in enumerate(rows[columns].to_numpy(float)):
                node = root
                while node[0] == "split":
                    node = node[3] if x[node[1]] <= node[2] else node[4]
                total[i] += node[1]
        want = dict(zip(rows["trade_date"], -(2.0 ** (-total / usual))))
        got = whole[whole["stock_id"] == stock_id]
        assert len(got) == len(want)
        for day, raw in zip(got["trade_date"], got["raw"]):
            assert raw == pytest.approx(want[day], rel=1e-12)


def test_forest(spark, frame):
    scored = written_once(anomaly.isolation_forest(frame, trees=30))
    by_stock = scored.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anomaly_flag").alias("flagged"),
        F.count_if(F.col("anomaly_flag") != (F.col("anomaly_score") < 0)).alias("odd"))
    for r in by_stock.collect():
        assert r.odd == 0
        assert r.flagged == pytest.approx(0.05 * r.rows, abs=1)
    again = anomaly.isolation_forest(
        frame.orderBy(F.rand(1)).repartition(5), trees=30)
    columns = ["stock_id", "trade_date", "anomaly_score"]
    assert sorted(map(tuple, scored.select(columns).collect())) == sorted(
        map(tuple, again.select(columns).collect()))


def test_chunks_do_not_change_scores(frame):
    forest = written_once(anomaly.grow_forest(anomaly.sample_for_trees(frame, trees=5)))
    whole, parts = (sorted(map(tuple, anomaly.score_forest(frame, forest, n).collect()))
                    for n in (50_000, 7))
    assert whole == parts


def test_an_extreme_day_is_flagged(spark, frame):
    columns = frame.columns
    worst = frame.where("stock_id = 1").limit(1).withColumns({
        "daily_return": F.lit(50.0), "volatility": F.lit(90.0),
        "volume_change_pct": F.lit(1e4), "trade_date": F.lit("2031-01-01").cast("date")})
    scored = written_once(anomaly.isolation_forest(
        frame.unionByName(worst.select(columns)), trees=50))
    lowest = scored.where("stock_id = 1").orderBy("anomaly_score").first()
    assert str(lowest.trade_date) == "2031-01-01" and lowest.anomaly_flag


def test_unknown_method(frame):
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(frame, method="other")
