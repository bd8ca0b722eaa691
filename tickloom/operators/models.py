"""The registered next-close models, behind one fit / predict / save interface."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.scalars import next_business_day
from tickloom.operators import boosting, linear
from tickloom.operators.boosting import BoostedModel, FoldedModel
from tickloom.operators.training import MODEL_NAMES, evaluate
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import written_once

META = ("_linear", "_boosted")
VERSIONS = "stock_id int, version bigint, trained_at timestamp"


@dataclass
class LinearModel:
    """One row of coefficients per instrument."""

    table: DataFrame

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        return linear.predict_linear(rows, self.table, output=output)


@dataclass
class StackedModel:
    """Linear and boosted predictions combined by a ridge per instrument."""

    linear: LinearModel
    boosted: BoostedModel
    meta: DataFrame

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        base = self.boosted.predict(self.linear.predict(rows, META[0]), META[1])
        return linear.predict_linear(base, self.meta, META, output=output).drop(*META)


def train_linear(train: DataFrame) -> LinearModel:
    return LinearModel(written_once(linear.fit_linear(train)))


def train_boosted(train: DataFrame, **settings) -> BoostedModel:
    return boosting.fit_boosted(train, **settings)


def train_forest(train: DataFrame, **settings) -> BoostedModel:
    """The optional random forest; of the settings, only those of a forest matter."""
    return boosting.fit_forest(train, **{k: v for k, v in settings.items() if k not in ("rounds", "step")})


def out_of_fold(train: DataFrame, folded: FoldedModel) -> DataFrame:
    """Both base predictions of every training row, by models that did not see its fold."""
    by_fold = linear.fit_linear_without_folds(train)
    rows = linear.predict_linear(train, by_fold, on=("stock_id", "fold"), output=META[0])
    return written_once(folded.predict_out_of_fold(rows, META[1]).select(
        "stock_id", "trade_date", "fold", "target", *META))


def train_stacking(
    train: DataFrame, folded: FoldedModel | None = None, plain: LinearModel | None = None, **settings
) -> StackedModel:
    """Five contiguous folds; the bases kept for prediction are fitted on all training rows.

    Bases that are fitted already can be given.
    """
    folded = folded or boosting.fit_folds(train, **settings)
    meta = written_once(linear.fit_ridge(out_of_fold(train, folded), META))
    return StackedModel(plain or train_linear(train), folded.whole(), meta)


Model = LinearModel | BoostedModel | StackedModel
MODEL_REGISTRY: dict[str, Callable[..., Model]] = {
    "linear_regression": lambda train, **_: train_linear(train),
    "xgboost": train_boosted,
    "stacking": train_stacking,
}
#: For those who ask for the optional model, too.
WITH_FOREST = {**MODEL_REGISTRY, "random_forest": train_forest}


def fit(
    model_name: str, train: DataFrame, registry: dict[str, Callable[..., Model]] = MODEL_REGISTRY, **settings
) -> Model:
    if model_name not in registry:
        raise ValueError(f"Unknown model type: {model_name}")
    return registry[model_name](train, **settings)


def _parts(model: Model) -> dict[str, DataFrame]:
    """The tables that make up a model, each with one or more rows per instrument."""
    if isinstance(model, LinearModel):
        return {"linear": model.table}
    if isinstance(model, BoostedModel):
        return {"trees": model.trees, "bases": model.bases}
    return {**_parts(model.linear), **_parts(model.boosted), "meta": model.meta}


def _built(model_name: str, part: Callable[[str], DataFrame]) -> Model:
    if model_name == "linear_regression":
        return LinearModel(part("linear"))
    if model_name == "stacking":
        return StackedModel(LinearModel(part("linear")), BoostedModel(part("trees"), part("bases")), part("meta"))
    return BoostedModel(part("trees"), part("bases"))


def model_versions(spark: SparkSession, folder: str, model_name: str) -> DataFrame:
    """All stored versions of a model: ``stock_id, version, trained_at``; no rows where none is stored."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{folder.rstrip('/')}/{model_name}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def newest_versions(spark: SparkSession, folder: str, model_name: str) -> DataFrame:
    """The newest stored version of each instrument."""
    newest = F.max(F.struct("version", "trained_at"))
    return model_versions(spark, folder, model_name).groupBy("stock_id").agg(newest.alias("v")).select(
        "stock_id", "v.*")


def save_model(
    model: Model, folder: str, model_name: str, trained_at: dt.datetime | None = None
) -> str:
    """Stores a new version of the instruments that the model has; others keep the one they have.

    A version counts once its rows in the list of versions are written, which is the last step.
    """
    path = f"{folder.rstrip('/')}/{model_name}"
    parts = _parts(model)
    spark = next(iter(parts.values())).sparkSession
    version = (model_versions(spark, folder, model_name).agg(F.max("version")).first()[0] or 0) + 1
    for name, table in parts.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    when = F.lit(trained_at).cast("timestamp") if trained_at else F.current_timestamp()
    next(iter(parts.values())).select(
        F.col("stock_id").cast("int"), F.lit(version).cast("bigint").alias("version"), when.alias("trained_at")
    ).distinct().write.mode("append").parquet(f"{path}/versions")
    return path


def load_model(spark: SparkSession, folder: str, model_name: str) -> Model | None:
    """The newest version of each instrument as one model, or None if none is stored."""
    newest = written_once(newest_versions(spark, folder, model_name).select("stock_id", "version"))
    if newest.isEmpty():
        return None

    def part(name: str) -> DataFrame:
        stored = spark.read.option("recursiveFileLookup", "false").parquet(
            f"{folder.rstrip('/')}/{model_name}/{name}")
        return stored.withColumn("version", F.col("version").cast("bigint")).join(
            newest, ["stock_id", "version"], "left_semi").drop("version")

    return _built(model_name, part)


def score_split(split: DataFrame, models: dict[str, Model], train: bool = False) -> DataFrame:
    """Predictions of all models on the held-out (or the training) rows."""
    rows = split.where(F.col("is_train") if train else ~F.col("is_train"))
    return reduce(DataFrame.unionByName, [
        model.predict(rows).select(
            "stock_id", "trade_date", "target", "predicted", F.lit(name).alias("model_name"))
        for name, model in models.items()])


def train_models(
    split: DataFrame, names: tuple[str, ...] = MODEL_NAMES,
    registry: dict[str, Callable[..., Model]] = MODEL_REGISTRY, **settings
) -> tuple[dict[str, Model], DataFrame]:
    """Fits the named models on the training rows; returns them and their held-out metrics.

    The stacked model shares its bases with the others where all are named.
    """
    train = split.where("is_train")
    models: dict[str, Model] = {}
    shared: dict = {}
    if "stacking" in names and "xgboost" in names and registry is MODEL_REGISTRY:
        shared["folded"] = boosting.fit_folds(train, **settings)
    for name in names:
        if name == "xgboost" and shared:
            models[name] = shared["folded"].whole()
        elif name == "stacking" and shared:
            models[name] = train_stacking(train, plain=models.get("linear_regression"), **shared, **settings)
        else:
            models[name] = fit(name, train, registry, **settings)
    return models, evaluate(score_split(split, models))


def predict_next_close(latest: DataFrame, model: Model, model_name: str) -> DataFrame:
    """Prediction rows for the newest feature rows; rows with a missing feature are skipped."""
    complete = latest.na.drop(subset=list(FEATURE_COLUMNS))
    return model.predict(complete).select(
        "stock_id", next_business_day("trade_date").alias("prediction_date"),
        F.round("predicted", 2).alias("predicted_close"), F.lit(model_name).alias("model_name"))


def union_predictions(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
