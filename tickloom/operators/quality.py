"""Quality checks of clean bars, per instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.series import BLOCK, Series, own_rows
from tickloom.schemas import OHLCV

MAX_GAP_DAYS = 5
PRICES = ("open", "high", "low", "close")
FEED = Series(key="symbol", order="date")

# The texts of the issues.
EMPTY = "DataFrame is empty"
NULLS = "Null values found: {%s}"
ZERO_VOLUME = "%d rows with zero volume"
NON_POSITIVE = "%d rows with non-positive {column}"
HIGH_BELOW_LOW = "%d rows where high < low"
GAPS = "%d date gaps > 5 days found (max gap: %.1f days)"


def _null_counts() -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in OHLCV]


def _zero_volume() -> Column:
    return F.count_if(F.col("volume") == 0).alias("zero_volume")


def _non_positive() -> list[Column]:
    return [F.count_if(F.col(c) <= 0).alias(f"non_positive_{c}") for c in PRICES]


def _high_below_low() -> Column:
    return F.count_if(F.col("high") < F.col("low")).alias("high_below_low")


def null_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*_null_counts())


def zero_volume(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(_zero_volume())


def non_positive(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*_non_positive())


def high_below_low(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(_high_below_low())


def with_gap(bars: DataFrame, series: Series = FEED) -> DataFrame:
    """Adds the calendar days since the preceding bar."""
    extended = series.extended(
        series.blocked(bars), totals={"_last": F.max(series.order)},
        before={"_date_before": F.max("_last")})
    previous = F.coalesce(F.lag(series.order).over(series.in_block), F.col("_date_before"))
    return own_rows(
        extended.withColumn("gap_days", F.datediff(series.order, previous))
    ).drop("_date_before", BLOCK)


def _gap_aggregates() -> list[Column]:
    wide = F.when(F.col("gap_days") > MAX_GAP_DAYS, F.col("gap_days"))
    return [F.count(wide).alias("gaps"), F.max(wide).alias("max_gap")]


def date_gaps(bars: DataFrame, series: Series = FEED) -> DataFrame:
    """Number and length of the gaps of more than five calendar days."""
    return with_gap(bars, series).groupBy(series.key).agg(*_gap_aggregates())


def quality_counts(bars: DataFrame, series: Series = FEED) -> DataFrame:
    """All checks in one aggregation."""
    return with_gap(bars, series).groupBy(series.key).agg(
        F.count(F.lit(1)).alias("rows"), *_null_counts(), _zero_volume(), *_non_positive(),
        _high_below_low(),
        *_gap_aggregates(),
    )


def issue_texts() -> Column:
    """The ordered issue strings of one row of ``quality_counts``."""
    def when_any(count: str, text: str, *more: Column) -> Column:
        return F.when(F.col(count) > 0, F.format_string(text, F.col(count), *more))

    nulls = F.concat_ws(", ", *[
        when_any(f"null_{c}", f"'{c}': %d") for c in OHLCV])
    return F.array_compact(F.array(
        F.when(F.coalesce("rows", F.lit(0)) == 0, EMPTY),
        F.when(nulls != "", F.format_string(NULLS, nulls)),
        when_any("zero_volume", ZERO_VOLUME),
        *[when_any(f"non_positive_{c}", NON_POSITIVE.format(column=c)) for c in PRICES],
        when_any("high_below_low", HIGH_BELOW_LOW),
        when_any("gaps", GAPS, F.col("max_gap").cast("double")),
    ))


def validate_quality(bars: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Per instrument: ``passed`` and the ordered ``issues``.

    Given a universe, instruments without any bar are reported as empty.
    """
    counts = quality_counts(bars)
    if universe is not None:
        counts = universe.select("symbol").distinct().join(counts, "symbol", "left")
    return (
        counts.withColumn("issues", issue_texts())
        .select("symbol", (F.size("issues") == 0).alias("passed"), "issues")
    )


def quality_gate(bars: DataFrame, report: DataFrame, on_fail: str = "warn") -> DataFrame:
    """What a failed report does: nothing, drop the instrument's bars, or stop the job."""
    if on_fail == "warn":
        return bars
    failed = report.where(~F.col("passed")).select("symbol")
    if on_fail == "drop_symbol":
        return bars.join(failed, "symbol", "left_anti")
    if on_fail == "raise":
        if not failed.isEmpty():
            raise ValueError("quality checks failed")
        return bars
    raise ValueError(f"unknown on_fail: {on_fail}")
