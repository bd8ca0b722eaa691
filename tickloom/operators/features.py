"""Technical features of daily bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalars import known, ratio
from tickloom.operators.series import Series, own_rows
from tickloom.schemas import FEATURE_COLUMNS

SHORT_AVERAGE, LONG_AVERAGE = 7, 30
MIN_ROWS = 2

BARS = Series()


def price_series(prices: DataFrame, stock_id: int | None = None) -> DataFrame:
    """Bars under short names, of all instruments or of one."""
    if stock_id is not None:
        prices = prices.where(F.col("stock_id") == stock_id)
    return prices.select(
        "stock_id", "trade_date",
        *[known(f"{name}_price").alias(name) for name in ("open", "high", "low", "close")],
        "volume",
    )


def price_difference() -> Column:
    return F.col("close") - F.col("open")


def volatility() -> Column:
    return ratio(F.col("high") - F.col("low"), F.col("open"))


def capital_flow_indicator() -> Column:
    return ratio(F.col("volume") * (F.col("close") - F.col("open")), F.col("open"))


def change_since_known(value: str, carried: str, series: Series = BARS) -> Column:
    """Relative change between the last known values at a row and at the row before it."""
    w = series.in_block
    so_far = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    until = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    previous = F.coalesce(until, F.col(carried))
    return ratio(F.coalesce(so_far, F.col(carried)), previous) - 1


def last_known(value: str, series: Series = BARS) -> Column:
    """Per block, the latest non-null value."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(series.order)))


def compute_features(
    prices: DataFrame, series: Series = BARS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The six features of every bar, for instruments with at least two bars.

    ``prices`` has the columns of ``price_series``; ``keep`` names input columns to pass on.
    """
    values = ("open", "high", "low", "close", "volume")
    bars = series.blocked(prices.select(
        series.key, series.order, *values, *[c for c in keep if c not in values]))
    extended = series.extended(
        bars, LONG_AVERAGE - 1,
        {"_n": F.count(F.lit(1)), "_close": last_known("close", series)},
        before={"_close_before": F.last("_close", ignorenulls=True)},
        overall={"_rows": F.sum("_n")},
    )
    w = series.in_block

    def average(rows: int) -> Column:
        return F.avg("close").over(w.rowsBetween(1 - rows, 0))

    return own_rows(
        extended.withColumns({
            "daily_return": change_since_known("close", "_close_before", series),
            "price_difference": price_difference(),
            "volatility": volatility(),
            "ma_7": average(SHORT_AVERAGE),
            "ma_30": average(LONG_AVERAGE),
            "capital_flow_indicator": capital_flow_indicator(),
        })
    ).where(F.col("_rows") >= MIN_ROWS).select(
        series.key, series.order, *keep, *FEATURE_COLUMNS)


def compute_features_for_stock(prices: DataFrame, stock_id: int) -> DataFrame:
    """Features of one instrument, straight from the price table."""
    return compute_features(price_series(prices, stock_id))


def rows_to_refresh(prices: DataFrame, since: dt.date, series: Series = BARS) -> DataFrame:
    """The bars from ``since`` on and the few before them that their features depend on.

    Those are the last bars that an average reaches back to, and the last known close. Both are
    reduced before the shuffle, so the history is read but not moved. ``is_sole`` marks an only
    earlier bar.
    """
    earlier = prices.where(F.col(series.order) < F.lit(since))
    latest_first = W.partitionBy(series.key).orderBy(F.desc(series.order))
    tail = (
        earlier.withColumn("_rank", F.row_number().over(latest_first))
        .where(F.col("_rank") < LONG_AVERAGE).drop("_rank")
        .withColumn("is_sole", F.count(F.lit(1)).over(W.partitionBy(series.key)) == 1)
    )
    known_days = F.when(F.col("close").isNotNull(), F.col(series.order))
    values = [c for c in prices.columns if c not in (series.key, series.order)]
    last_close = earlier.groupBy(series.key).agg(
        F.max(known_days).alias(series.order),
        *[F.max_by(c, known_days).alias(c) for c in values],
    ).where(F.col(series.order).isNotNull()).withColumn("is_sole", F.lit(False))
    beyond_tail = last_close.join(tail, [series.key, series.order], "left_anti")
    later = prices.where(F.col(series.order) >= F.lit(since)).withColumn(
        "is_sole", F.lit(False))
    return later.unionByName(tail).unionByName(beyond_tail)


def refreshed_features(prices: DataFrame, since: dt.date, series: Series = BARS) -> DataFrame:
    """The feature rows that bars from ``since`` on add or change.

    These are the rows from ``since`` on, and the first row of an instrument that had a single bar
    until then, too few for features.
    """
    rows = compute_features(rows_to_refresh(prices, since, series), series, keep=("is_sole",))
    return rows.where((F.col(series.order) >= F.lit(since)) | F.col("is_sole")).drop("is_sole")
