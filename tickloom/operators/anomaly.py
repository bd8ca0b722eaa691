"""Outlier detection with an isolation forest per instrument."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.operators.features import change_since_known, last_known
from tickloom.operators.joins import join_per_stock
from tickloom.operators.quantiles import exact_quantile
from tickloom.operators.series import BLOCK, Series, own_rows
from tickloom.operators.training import DAYS
from tickloom.schemas import ANOMALY_FEATURES
from tickloom.session import written_once

# The detector's defaults.
METHOD = "isolation_forest"
MIN_ROWS = 30
TREES, SAMPLE_ROWS, CONTAMINATION, SEED = 100, 256, 0.05, 42

CHUNK_ROWS = 50_000
TREE_SCHEMA = ("stock_id int, tree int, sampled int, feature array<int>, "
               "threshold array<double>")
SCORE_SCHEMA = "stock_id int, trade_date date, raw double"


def volume_change(joined: DataFrame, series: Series = DAYS) -> DataFrame:
    """Adds the relative volume change, NULL after a day without volume, and the row count."""
    extended = series.extended(
        series.blocked(joined),
        totals={"_n": F.count(F.lit(1)), "_volume": last_known("volume", series)},
        before={"_volume_before": F.last("_volume", ignorenulls=True)},
        overall={"joined_rows": F.sum("_n")},
    )
    change = change_since_known("volume", "_volume_before", series)
    return own_rows(extended.withColumn("volume_change_pct", change)).drop(
        BLOCK, "_volume_before")


def anomaly_frame(joined: DataFrame, series: Series = DAYS) -> DataFrame:
    """Complete rows of instruments with at least thirty rows before and after the drop.

    ``rows`` is the number of complete rows of the instrument.
    """
    complete = volume_change(joined, series).where(F.col("joined_rows") >= MIN_ROWS).na.drop(
        subset=list(ANOMALY_FEATURES))
    counts = complete.groupBy("stock_id").agg(F.count(F.lit(1)).alias("rows"))
    return complete.drop("joined_rows").join(
        counts.where(F.col("rows") >= MIN_ROWS), "stock_id")


def drawn_places(
    sizes: DataFrame, trees: int = TREES, sample: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """For each instrument and tree ``sample`` distinct positions from 1 to ``total``, or all, in drawn order.

    Drawing takes as long as the sample is large, whatever ``total`` is.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stock_id, tree, total in zip(*(c.to_pylist() for c in batch.columns)):
                random = np.random.default_rng([seed, stock_id, tree, 1])
                places = random.choice(total, min(sample, total), replace=False, shuffle=True) + 1
                count = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, stock_id, np.int32)), pa.array(np.full(count, tree, np.int32)),
                     pa.array(places.astype(np.int64)), pa.array(np.arange(1, count + 1, dtype=np.int32))],
                    ["stock_id", "tree", "position", "_rank"])

    each = sizes.select("stock_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                        F.col("total").cast("bigint"))
    return each.mapInArrow(draw, "stock_id int, tree int, position bigint, _rank int")


def sample_for_trees(
    frame: DataFrame, trees: int = TREES, sample: int = SAMPLE_ROWS, seed: int = SEED,
    series: Series = DAYS,
) -> DataFrame:
    """For each instrument and tree a random subset of ``sample`` rows.

    Rows get their positions block by block and are joined once with the positions drawn for all trees.
    """
    placed = written_once(series.positions(frame.select("stock_id", "trade_date", *ANOMALY_FEATURES)))
    sizes = placed.groupBy("stock_id").agg(F.max("position").alias("total"))
    drawn = drawn_places(sizes, trees, sample, seed)
    return placed.drop("total").withColumn("position", F.col("position").cast("bigint")).join(
        drawn, ["stock_id", "position"])


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3)
    long = 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
    """One random tree, its nodes numbered as in a heap; leaves hold their path length."""
    stock_id, tree = (int(k) for k in key)
    points = sample.sort_values("_rank")[list(ANOMALY_FEATURES)].to_numpy(dtype=float)
    random = np.random.default_rng([SEED, stock_id, tree])
    depth = int(np.ceil(np.log2(max(len(points), 2))))
    feature = np.full(2 ** (depth + 1) - 1, -1)
    threshold = np.zeros(len(feature))
    waiting = [(0, 0, points)]
    while waiting:
        node, level, part = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if level == depth or len(part) < 2 or not len(varying):
            threshold[node] = level + average_path(len(part))
            continue
        feature[node] = f = random.choice(varying)
        threshold[node] = cut = random.uniform(low[f], high[f])
        left = part[:, f] <= cut
        waiting += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
    return pd.DataFrame({
        "stock_id": [stock_id], "tree": [tree], "sampled": [len(points)],
        "feature": [feature.tolist()], "threshold": [threshold.tolist()]})


def grow_forest(samples: DataFrame) -> DataFrame:
    """One row per instrument and tree; a task sees one tree's sample at a time."""
    return samples.select("stock_id", "tree", "_rank", *ANOMALY_FEATURES).groupBy(
        "stock_id", "tree").applyInPandas(_grow, TREE_SCHEMA)


def _score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
    """Negated anomaly scores of a chunk of rows, all of one instrument."""
    points = rows[list(ANOMALY_FEATURES)].to_numpy(dtype=float)
    total = np.zeros(len(points))
    usual = 0.0
    for _, tree in forest.sort_values("tree").iterrows():
        feature, threshold = np.asarray(tree["feature"]), np.asarray(tree["threshold"])
        node = np.zeros(len(points), dtype=int)
        for _ in range(int(np.log2(len(feature) + 1)) - 1):
            split = feature[node]
            value = np.take_along_axis(points, np.maximum(split, 0)[:, None], axis=1)[:, 0]
            child = 2 * node + 1 + (value > threshold[node])
            node = np.where(split >= 0, child, node)
        total += threshold[node]
        usual += average_path(tree["sampled"])
    return pd.DataFrame({
        "stock_id": rows["stock_id"], "trade_date": rows["trade_date"],
        "raw": -(2.0 ** (-total / max(usual, 1e-300)))})


def score_forest(frame: DataFrame, forest: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Scores rows where their instrument's trees are; a long series is spread over chunks."""
    chunks = F.ceil(F.col("rows") / chunk_rows).cast("int")
    rows = frame.select(
        "stock_id", F.pmod(F.xxhash64("trade_date"), chunks).cast("int").alias("_chunk"),
        "trade_date", *ANOMALY_FEATURES)
    per_stock = frame.groupBy("stock_id").agg(F.max(chunks).alias("_chunks"))
    copies = forest.join(per_stock, "stock_id").select(
        "stock_id", "tree", "sampled", "feature", "threshold",
        F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    return rows.groupBy("stock_id", "_chunk").cogroup(
        copies.groupBy("stock_id", "_chunk")).applyInPandas(_score, SCORE_SCHEMA)


def anomaly_flags(
    raw_scores: DataFrame, contamination: float = CONTAMINATION, method: str = METHOD
) -> DataFrame:
    """Anomaly rows: scores shifted so that the given share of an instrument lies below zero."""
    offset = exact_quantile(raw_scores, "stock_id", "raw", contamination)
    score = F.col("raw") - F.col("quantile")
    return join_per_stock(raw_scores, offset).select(
        "stock_id", "trade_date", score.alias("anomaly_score"),
        (score < 0).alias("anomaly_flag"), F.lit(method).alias("model_name"))


def isolation_forest(
    frame: DataFrame, trees: int = TREES, sample: int = SAMPLE_ROWS,
    contamination: float = CONTAMINATION,
) -> DataFrame:
    """Scores and flags of ``anomaly_frame`` rows.

    Frame and raw scores are checkpointed: both are read more than once, and fitting is not to be
    repeated when an executor is lost.
    """
    rows = written_once(frame.select("stock_id", "trade_date", "rows", *ANOMALY_FEATURES))
    forest = grow_forest(sample_for_trees(rows, trees, sample))
    return anomaly_flags(written_once(score_forest(rows, forest)), contamination)


def detect_anomalies(
    joined: DataFrame, method: str = METHOD, contamination: float = CONTAMINATION,
    trees: int = TREES,
) -> DataFrame:
    """Anomaly rows of all instruments, from joined prices and features."""
    if method != METHOD:
        raise ValueError(f"Unknown anomaly method: {method}")
    return isolation_forest(anomaly_frame(joined), trees, contamination=contamination)
