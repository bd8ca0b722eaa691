"""Turning raw feed rows into clean daily bars.

A feed row has ``seq`` (ingest order, unique within an instrument and date), ``symbol``, ``date``
and the five OHLCV columns, as text or numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalars import known, to_day, to_number, to_volume
from tickloom.schemas import OHLCV


def drop_null_ohlcv(feed: DataFrame) -> DataFrame:
    """Drops rows in which any of the five values is missing as delivered."""
    return feed.na.drop(subset=list(OHLCV))


def dedup_dates(feed: DataFrame) -> DataFrame:
    """One row per instrument and date, the first delivered.

    An aggregate rather than a window, so that copies shrink before they are shuffled. Rows that tie
    in ``seq`` are ordered by their values, and one of them is taken as a whole.
    """
    values = [c for c in feed.columns if c not in ("symbol", "date", "seq")]
    first = feed.groupBy("symbol", "date").agg(F.min(F.struct("seq", *values)).alias("first"))
    return first.select("symbol", "date", "first.*")


def coerce_types(feed: DataFrame) -> DataFrame:
    """Dates to DATE, prices to DOUBLE, volume to BIGINT; what does not parse becomes NULL."""
    return feed.withColumns({
        "date": to_day("date"),
        **{name: to_number(name) for name in OHLCV if name != "volume"},
        "volume": to_volume("volume"),
    })


def clean_stock_data(feed: DataFrame) -> DataFrame:
    """Clean bars: one per instrument and date.

    Missing values are judged as delivered, so a value that fails to parse stays as NULL. Numbers
    are parsed before duplicates are removed: which row is kept depends on ``seq`` alone, and
    fixed-width values keep the aggregation in the hash path. Rows without a readable date have
    no place in a series and are dropped.
    """
    parsed = coerce_types(drop_null_ohlcv(feed.select("seq", "symbol", "date", *OHLCV)))
    return dedup_dates(parsed.where(F.col("date").isNotNull()))


def cleaning_report(feed: DataFrame) -> DataFrame:
    """Per instrument: rows delivered, kept and dropped.

    Kept rows are the distinct dates among rows without a missing value.
    """
    complete = F.lit(True)
    for name in OHLCV:
        complete = complete & F.col(name).isNotNull()
        if dict(feed.dtypes)[name] in ("double", "float"):
            complete = complete & ~F.isnan(name)
    per_day = (
        feed.select("symbol", to_day("date").alias("date"), complete.alias("_complete"))
        .groupBy("symbol", "date")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_complete").alias("_kept"))
    )
    kept = F.count_if(F.col("_kept") & F.col("date").isNotNull())
    return per_day.groupBy("symbol").agg(
        F.sum("_rows").alias("initial_rows"),
        kept.alias("kept_rows"),
        (F.sum("_rows") - kept).alias("dropped_rows"),
    )


def load_casts(bars: DataFrame) -> DataFrame:
    """Storage types: plain dates, NaN to NULL, and zero for an unknown volume."""
    return bars.withColumns({
        "date": F.col("date").cast("date"),
        **{name: known(name) for name in OHLCV if name != "volume"},
        "volume": F.coalesce(known("volume").cast("bigint"), F.lit(0).cast("bigint")),
    })
