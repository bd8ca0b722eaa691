"""Supervised frames, the chronological split, evaluation and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.series import BLOCK, Series, own_rows
from tickloom.schemas import FEATURE_COLUMNS

MIN_TRAINING_ROWS = 60
TRAIN_SHARE = 0.8
FOLDS = 5
LATEST_ROWS = 8
# Model names, in the order in which ties are resolved.
MODEL_NAMES = ("linear_regression", "xgboost", "stacking")

DAYS = Series()


def with_next_close(joined: DataFrame, series: Series = DAYS) -> DataFrame:
    """Adds ``target``, the close of the next row, and ``joined_rows``, the instrument's rows.

    The rows keep their block.
    """
    extended = series.extended(
        series.blocked(joined),
        totals={"_n": F.count(F.lit(1)),
                "_first": F.min_by(F.struct("close_price"), series.order)},
        overall={"joined_rows": F.sum("_n")},
        after={"_next_first": F.first("_first", ignorenulls=True)},
    )
    w = series.in_block
    last_of_block = F.lead(series.order).over(w).isNull()
    target = F.when(last_of_block, F.col("_next_first.close_price")).otherwise(
        F.lead("close_price").over(w))
    return own_rows(extended.withColumn("target", target)).drop("_next_first")


def training_frame(joined: DataFrame, series: Series = DAYS) -> DataFrame:
    """Complete rows with a target, of instruments with at least sixty joined rows."""
    return _training_rows(joined, series).drop(BLOCK)


def training_split(joined: DataFrame, series: Series = DAYS) -> DataFrame:
    """The split training frame, from one shuffle of the joined rows."""
    return chrono_split(_training_rows(joined, series), series)


def _training_rows(joined: DataFrame, series: Series) -> DataFrame:
    return (
        with_next_close(joined, series)
        .where(F.col("joined_rows") >= MIN_TRAINING_ROWS)
        .drop("joined_rows")
        .na.drop(subset=[*FEATURE_COLUMNS, "target"])
    )


def train_rows(total: Column | str = "total") -> Column:
    total = F.col(total) if isinstance(total, str) else total
    return F.floor(total * F.lit(TRAIN_SHARE))


def chrono_split(frame: DataFrame, series: Series = DAYS) -> DataFrame:
    """Adds position, total, ``is_train`` (the first four fifths in time) and the fold."""
    return (
        series.positions(frame)
        .withColumn("is_train", F.col("position") <= train_rows())
        .withColumn("fold", F.when(F.col("is_train"), fold_of("position", train_rows())))
    )


def fold_of(position: str, rows: Column, folds: int = FOLDS) -> Column:
    """Contiguous folds numbered from 0; the first ``rows % folds`` are one row longer."""
    long_folds = rows % folds
    size = F.floor(rows / folds)
    at = F.col(position) - 1
    in_long = long_folds * (size + 1)
    return F.when(at < in_long, F.floor(at / (size + 1))).otherwise(
        long_folds + F.floor((at - in_long) / F.greatest(size, F.lit(1)))).cast("int")


def evaluate(scored: DataFrame, by: Sequence[str] = ("stock_id", "model_name")) -> DataFrame:
    """RMSE, MAE and R² of ``predicted`` against ``target``.

    With a constant target R² is 1 for an exact prediction and 0 otherwise; with one row it is
    NULL.
    """
    error = F.col("predicted") - F.col("target")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(error * error).alias("_sse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("target").alias("_variance"),
        (F.min("target") == F.max("target")).alias("_constant"),
    )
    r2 = (
        F.when(F.col("rows") < 2, F.lit(None).cast("double"))
        .when(F.col("_constant"), F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
        .otherwise(1 - ratio(F.col("_sse"), F.col("_variance") * F.col("rows")))
    )
    return sums.select(
        *by, "rows", F.sqrt(F.col("_sse") / F.col("rows")).alias("rmse"), "mae", r2.alias("r2"))


def train_report(
    joined: DataFrame, split: DataFrame, metrics: DataFrame | None = None,
    models: Sequence[str] = MODEL_NAMES,
) -> DataFrame:
    """One row per instrument and model: sizes, status, and the reason of a skip."""
    rows = joined.groupBy("stock_id").agg(F.count(F.lit(1)).alias("joined_rows"))
    sizes = split.groupBy("stock_id").agg(
        F.count_if("is_train").alias("train_size"),
        F.count_if(~F.col("is_train")).alias("test_size"))
    names = F.array(*[F.lit(m) for m in models])
    enough = F.col("joined_rows") >= MIN_TRAINING_ROWS
    known = F.col("model_name").isin(*MODEL_NAMES)
    status = F.when(known & enough, "trained").otherwise("skipped")
    reason = (
        F.when(~known, F.concat(F.lit("Unknown model type: "), F.col("model_name")))
        .when(~enough, F.format_string("Insufficient data: %d rows (need ≥60)", "joined_rows"))
    )
    report = (
        rows.join(sizes, "stock_id", "left")
        .withColumn("model_name", F.explode(names))
        .select(
            "stock_id", "model_name", status.alias("status"), reason.alias("reason"),
            F.when(status == "trained", F.coalesce("train_size", F.lit(0))).alias("train_size"),
            F.when(status == "trained", F.coalesce("test_size", F.lit(0))).alias("test_size"))
    )
    if metrics is None:
        return report
    return report.join(
        metrics.select("stock_id", "model_name", "rmse", "mae", "r2"),
        ["stock_id", "model_name"], "left")


def compare_models(metrics: DataFrame) -> DataFrame:
    """The model with the highest R² per symbol, among symbols with a linear result.

    A missing R² ranks last and ties go to the earlier model.
    """
    def r2_of(model: str) -> Column:
        return F.max(F.when(F.col("model_name") == model, F.col("r2")))

    wide = metrics.groupBy("symbol").agg(
        *[r2_of(m).alias(f"r2_{m}") for m in MODEL_NAMES],
        F.max(F.col("model_name") == MODEL_NAMES[0]).alias("_has_linear"))
    r2 = [F.coalesce(f"r2_{m}", F.lit(float("-inf"))) for m in MODEL_NAMES]
    best = F.greatest(*r2)
    name = F.when(r2[0] == best, MODEL_NAMES[0]).when(r2[1] == best, MODEL_NAMES[1]).otherwise(
        MODEL_NAMES[2])
    return wide.where("_has_linear").withColumn("best_model", name).select(
        "symbol", *[f"r2_{m}" for m in MODEL_NAMES], "best_model")


def latest_features(features: DataFrame, rows: int = LATEST_ROWS) -> DataFrame:
    """The newest feature rows of each instrument."""
    newest = W.partitionBy("stock_id").orderBy(F.desc("trade_date"))
    return (
        features.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= rows).drop("_rank")
    )
