"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

SATURDAY, SUNDAY = 7, 1


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def known(column: Column | str) -> Column:
    """NULL in place of NaN and of either infinity, so that one kind of missing value is left."""
    c = _col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(_col(numerator), _col(denominator))


def to_number(column: Column | str) -> Column:
    """A text or number as DOUBLE; whatever does not parse becomes NULL."""
    return known(_col(column).try_cast("double"))


def to_volume(column: Column | str) -> Column:
    """A number as BIGINT, its fraction cut off; unparsable text becomes NULL."""
    return to_number(column).try_cast("bigint")


def to_day(column: Column | str) -> Column:
    """The calendar date of a date, timestamp or text, or NULL."""
    return _col(column).try_cast("timestamp").cast("date")


def sort_key(first: Column | str, *rest: tuple[Column | str, int]) -> Column:
    """Non-negative whole numbers as one DECIMAL(38, 0) that sorts like the tuple.

    Each further number comes with the digits it may have. Unlike a struct the key has a fixed
    width, which keeps ``min_by`` and ``max_by`` in the hash aggregate.
    """
    key = _col(first).cast("decimal(38,0)")
    for number, digits in rest:
        key = (key * F.lit(Decimal(10) ** digits)).cast("decimal(38,0)") + _col(number)
    return key.cast("decimal(38,0)")


def epoch_to_date(seconds: Column | str) -> Column:
    return F.to_date(F.timestamp_seconds(_col(seconds)))


def date_to_epoch(day: Column | str) -> Column:
    return F.unix_seconds(_col(day).cast("timestamp"))


def next_business_day(day: Column | str) -> Column:
    """The following calendar day, moved past a weekend; holidays are not known."""
    d = _col(day)
    tomorrow = F.dayofweek(F.date_add(d, 1))
    return (
        F.when(tomorrow == SATURDAY, F.date_add(d, 3))
        .when(tomorrow == SUNDAY, F.date_add(d, 2))
        .otherwise(F.date_add(d, 1))
    )


def _formatted(pattern: str, *columns: Column) -> Column:
    """Formatted values, or NULL if one is missing."""
    known = columns[0].isNotNull()
    for column in columns[1:]:
        known = known & column.isNotNull()
    return F.when(known, F.format_string(pattern, *columns))


def money(column: Column | str) -> Column:
    return _formatted("$%.2f", _col(column))


def whole_money(column: Column | str) -> Column:
    return _formatted("$%,.0f", _col(column))


def signed(column: Column | str) -> Column:
    return _formatted("%+.2f", _col(column))


def signed_percent(column: Column | str) -> Column:
    return _formatted("%+.2f%%", _col(column))


def delta_text(change: Column | str, percent: Column | str) -> Column:
    return _formatted("%+.2f (%+.2f%%)", _col(change), _col(percent))


def grouped_count(column: Column | str) -> Column:
    return _formatted("%,d", _col(column).cast("bigint"))


def day_text(column: Column | str) -> Column:
    return F.date_format(_col(column), "yyyy-MM-dd")


def decimals(column: Column | str, places: int) -> Column:
    return _formatted(f"%.{places}f", _col(column))


def model_title(column: Column | str) -> Column:
    return F.initcap(F.replace(_col(column), F.lit("_"), F.lit(" ")))


def stock_label(symbol: Column | str, company: Column | str) -> Column:
    return F.concat_ws(" — ", _col(symbol), _col(company))


def label_symbol(label: Column | str) -> Column:
    return F.split_part(_col(label), F.lit(" — "), F.lit(1))
