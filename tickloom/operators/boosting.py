"""Boosted trees and random forests, one model per instrument, fitted over all instruments at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.training import FOLDS
from tickloom.operators.trees import BLOCK_ROWS, Boosting, Forest, fit_trees, predict_trees
from tickloom.session import written_once

# The boosting defaults.
ROUNDS, DEPTH, STEP, SEED = 100, 6, 0.3, 42
#: Levels of a tree of the forest.
FOREST_DEPTH = 8


@dataclass
class BoostedModel:
    """The trees of each instrument (rows of ``trees.TREES``) and the values that they start from."""

    trees: DataFrame
    bases: DataFrame

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        """Predicted next close of rows with the six features; rows of unknown instruments are dropped."""
        return predict_trees(rows, self.trees, self.bases, output=output)


@dataclass
class FoldedModel:
    """The trees fitted on all rows (key -1) and on those outside each fold (its number)."""

    trees: DataFrame
    bases: DataFrame

    def whole(self) -> BoostedModel:
        return BoostedModel(self.trees.where("key = -1"), self.bases)

    def predict_out_of_fold(self, rows: DataFrame, output: str) -> DataFrame:
        """Rows with a ``fold``, each predicted by the trees that did not see its fold."""
        return predict_trees(rows, self.trees.where("key >= 0"), self.bases, key=F.col("fold"), output=output)


def mean_targets(train: DataFrame, folds: int = 0) -> DataFrame:
    """Per instrument the mean target of all rows, then of those outside each fold."""
    def outside(fold: int) -> Column:
        return F.coalesce(F.avg(F.when(F.col("fold") != fold, F.col("target"))), F.lit(0.0))

    return written_once(train.groupBy("stock_id").agg(
        F.array(F.avg("target"), *[outside(f) for f in range(folds)]).alias("base")))


def fit_boosted(
    train: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP,
    block_rows: int = BLOCK_ROWS,
) -> BoostedModel:
    """Rounds of second-order boosting from the mean target, with quantile bins and a penalty of 1 on leaves."""
    bases = mean_targets(train)
    return BoostedModel(fit_trees(train, Boosting(rounds, depth, step), bases, block_rows=block_rows), bases)


def fit_folds(
    train: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP,
    block_rows: int = BLOCK_ROWS,
) -> FoldedModel:
    """The boosted model and one without each fold, grown together: a fold is a further key of the sums."""
    bases = mean_targets(train, FOLDS)
    growth = Boosting(rounds, depth, step, keys=(-1, *range(FOLDS)))
    return FoldedModel(fit_trees(train, growth, bases, block_rows=block_rows), bases)


def fit_forest(
    train: DataFrame, trees: int = ROUNDS, depth: int = FOREST_DEPTH, seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> BoostedModel:
    """The optional random forest: trees on rows weighted by hashed Poisson numbers, leaves their averages."""
    bases = mean_targets(train)
    return BoostedModel(fit_trees(train, Forest(trees, depth, seed), bases, block_rows=block_rows), bases)
