"""Least squares per instrument from sums, so that no instrument's rows are ever gathered."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.joins import join_per_stock
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import written_once

ALPHAS = (0.1, 1.0, 10.0)
RELATIVE_CUTOFF = 1e-12


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _solver(n: int):
    """Solves the stacked normal equations of a batch of groups.

    Input rows are the sums of standardised columns: count, n feature sums, the target sum, the
    feature cross-products in ``_pairs`` order and the n products with the target. Output rows are
    n slopes and the intercept in standardised units. Directions without variance get no weight.
    """
    pairs = _pairs(n)

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        if sums.empty:
            return pd.Series([], dtype=object)
        a = np.vstack([np.asarray(s, dtype=float) for s in sums])
        count, sx, sy = a[:, 0], a[:, 1:n + 1], a[:, n + 1]
        sxx = np.zeros((len(a), n, n))
        for k, (i, j) in enumerate(pairs):
            sxx[:, i, j] = sxx[:, j, i] = a[:, n + 2 + k]
        sxy = a[:, n + 2 + len(pairs):]
        rows = np.maximum(count, 1)[:, None]
        centred = sxx - sx[:, :, None] * sx[:, None, :] / rows[:, :, None]
        products = sxy - sx * sy[:, None] / rows
        inverse = np.linalg.pinv(centred, rcond=RELATIVE_CUTOFF, hermitian=True)
        slopes = np.einsum("gij,gj->gi", inverse, products)
        intercept = (sy - (slopes * sx).sum(axis=1)) / rows[:, 0]
        return pd.Series(list(np.column_stack([slopes, intercept])))

    return solve


def _standard_stats(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return rows.groupBy("stock_id").agg(
        F.avg(target).alias("_mean_y"),
        *[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"_std_{i}") for i, c in enumerate(features)])


def _z(features: Sequence[str]) -> list[Column]:
    return [
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_mean_{i}"), F.col(f"_std_{i}")), F.lit(0.0))
        for i, c in enumerate(features)
    ]


def _sums(stats_joined: DataFrame, by: Sequence[str], features: Sequence[str], target: str):
    z, y = _z(features), F.col(target) - F.col("_mean_y")
    parts = [F.lit(1.0), *z, y, *[z[i] * z[j] for i, j in _pairs(len(z))], *[c * y for c in z]]
    return stats_joined.groupBy(*by).agg(*[F.sum(p).alias(f"_s{k}") for k, p in enumerate(parts)])


def _unscale(solved: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Slopes and intercept in the units of the columns."""
    n = len(features)
    slopes = [F.coalesce(F.try_divide(F.col("_w")[i], F.col(f"_std_{i}")), F.lit(0.0))
              for i in range(n)]
    shift = sum((slopes[i] * F.col(f"_mean_{i}") for i in range(n)), F.lit(0.0))
    return solved.select(
        *keys, F.array(*slopes).alias("coefficients"),
        (F.col("_w")[n] + F.col("_mean_y") - shift).alias("intercept"))


def fit_linear(
    rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, target: str = "target"
) -> DataFrame:
    """One row per instrument: ``coefficients`` in feature order and ``intercept``.

    Columns are standardised per instrument before their products are summed, since the two moving
    averages are nearly collinear; only one row of sums per instrument reaches Python.
    """
    stats = written_once(_standard_stats(rows, features, target))
    sums = _sums(join_per_stock(rows, stats), ["stock_id"], features, target)
    solve = _solver(len(features))
    columns = F.array(*[c for c in sums.columns if c.startswith("_s")])
    solved = sums.select("stock_id", solve(columns).alias("_w")).join(stats, "stock_id")
    return _unscale(solved, ["stock_id"], features)


def fit_linear_without_folds(
    rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, target: str = "target"
) -> DataFrame:
    """For each instrument and fold, the fit on all other folds.

    The sums of the other folds are the instrument's sums minus the fold's, so one pass over the
    rows serves all fits.
    """
    stats = written_once(_standard_stats(rows, features, target))
    by_fold = _sums(join_per_stock(rows, stats), ["stock_id", "fold"], features, target)
    names = [c for c in by_fold.columns if c.startswith("_s")]
    total = by_fold.groupBy("stock_id").agg(*[F.sum(c).alias(f"_t{c}") for c in names])
    rest = F.array(*[F.col(f"_t{c}") - F.col(c) for c in names])
    solve = _solver(len(features))
    solved = (
        by_fold.join(total, "stock_id").select("stock_id", "fold", solve(rest).alias("_w"))
        .join(stats, "stock_id")
    )
    return _unscale(solved, ["stock_id", "fold"], features)


def linear_value(features: Sequence[str] = FEATURE_COLUMNS) -> Column:
    """Value of the model whose ``coefficients`` and ``intercept`` are on the row."""
    terms = [F.col("coefficients")[i] * F.col(c) for i, c in enumerate(features)]
    return sum(terms, F.col("intercept"))


def predict_linear(
    rows: DataFrame, models: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
    on: Sequence[str] = ("stock_id",), output: str = "predicted",
) -> DataFrame:
    return (
        join_per_stock(rows, models.select(*on, "coefficients", "intercept"), on)
        .withColumn(output, linear_value(features))
        .drop("coefficients", "intercept")
    )


def _ridge_solver(n: int, alphas: Sequence[float]):
    """For each penalty the inverse of the penalised products, row by row, and the slopes."""
    pairs = _pairs(n)

    @F.pandas_udf("array<array<double>>")
    def solve(sums: pd.Series) -> pd.Series:
        if sums.empty:
            return pd.Series([], dtype=object)
        a = np.vstack([np.asarray(s, dtype=float) for s in sums])
        products = np.zeros((len(a), n, n))
        for k, (i, j) in enumerate(pairs):
            products[:, i, j] = products[:, j, i] = a[:, k]
        parts = []
        for alpha in alphas:
            inverse = np.linalg.inv(products + alpha * np.eye(n))
            slopes = np.einsum("gij,gj->gi", inverse, a[:, len(pairs):])
            parts.append(np.column_stack([inverse.reshape(len(a), -1), slopes]))
        return pd.Series([[p[g].tolist() for p in parts] for g in range(len(a))])

    return solve


def fit_ridge(
    rows: DataFrame, features: Sequence[str], target: str = "target",
    alphas: Sequence[float] = ALPHAS,
) -> DataFrame:
    """Ridge per instrument on any number of features, its penalty chosen by leave-one-out error.

    The leave-one-out error of a row is its residual divided by one minus its leverage, an
    expression of the row and the instrument's sums; ties go to the smaller penalty. Penalties must be above 0.
    """
    n, alphas = len(features), sorted(alphas)
    means = written_once(rows.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(target).alias("_my"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)]))
    x, y = [F.col(f"_x{i}") for i in range(n)], F.col("_y")
    centred = join_per_stock(rows, means).withColumns({
        "_y": F.col(target) - F.col("_my"),
        **{f"_x{i}": F.col(c) - F.col(f"_m{i}") for i, c in enumerate(features)}})
    products = centred.groupBy("stock_id").agg(F.array(
        *[F.sum(x[i] * x[j]) for i, j in _pairs(n)], *[F.sum(x[i] * y) for i in range(n)]).alias("_sums"))
    solved = written_once(products.select(
        "stock_id", _ridge_solver(n, alphas)("_sums").alias("_solved")))

    def left_out(k: int) -> Column:
        values = F.col("_solved")[k]
        spread = sum((values[i * n + j] * x[i] * x[j] for i in range(n) for j in range(n)), 1 / F.col("_n"))
        residual = sum((-values[n * n + i] * x[i] for i in range(n)), y)
        return F.try_divide(residual, 1 - spread)

    errors = join_per_stock(centred, solved).groupBy("stock_id").agg(*[
        F.coalesce(F.sum(left_out(k) * left_out(k)), F.lit(float("inf"))).alias(f"_e{k}")
        for k in range(len(alphas))])
    best = F.array_min(F.array(*[F.struct(F.col(f"_e{k}").alias("e"), F.lit(k).alias("k"))
                                 for k in range(len(alphas))]))["k"]
    chosen = errors.select("stock_id", best.alias("_k")).join(solved, "stock_id").join(means, "stock_id")
    slopes = F.slice(F.col("_solved")[F.col("_k")], n * n + 1, n)
    shift = sum((slopes[i] * F.col(f"_m{i}") for i in range(n)), F.lit(0.0))
    return chosen.select(
        "stock_id", F.array(*[F.lit(float(a)) for a in alphas])[F.col("_k")].alias("alpha"),
        slopes.alias("coefficients"), (F.col("_my") - shift).alias("intercept"))
