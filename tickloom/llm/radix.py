"""Ranks by a distributed radix sort, least significant digit first.

Rows carry a place. A pass over one digit of the key is a stable counting sort: rows are counted by (block of
places, digit); prefix sums over smaller digits, and over earlier blocks of the same digit, give each block
the destination of its first row with that digit; rows of a block and digit follow in the order of their
places. After the pass over the most significant digit the place is the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tickloom.llm.tables import OWN
from tickloom.session import written_once

#: Bits of a digit.
DIGIT_BITS = 11
#: Places of a block, as a power of two.
BLOCK_BITS = 16

SIGN = -(1 << 63)


def digits(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int) -> list[Column]:
    """The digits of the composite key in which rows differ, the least significant first.

    ``keys`` are pairs of a long column and whether larger values come first; the first counts most.
    """
    bounds = rows.agg(*[f(name).alias(f"{f.__name__}{i}") for i, (name, _) in enumerate(keys)
                        for f in (F.min, F.max)]).first()
    found = []
    for i, (name, falling) in reversed(list(enumerate(keys))):
        low, high = bounds[f"min{i}"], bounds[f"max{i}"]
        if low is None or low == high:
            continue
        span = high - low
        if span < 1 << 63:
            value = F.lit(high) - F.col(name) if falling else F.col(name) - F.lit(low)
        else:  # as unsigned numbers: no difference of two of them fits
            value, span = F.col(name).bitwiseXOR(F.lit(SIGN)), (1 << 64) - 1
            value = F.bitwise_not(value) if falling else value
        found += [F.shiftrightunsigned(value, shift).bitwiseAND((1 << digit_bits) - 1)
                  for shift in range(0, span.bit_length(), digit_bits)]
    return found


def counting_pass(rows: DataFrame, digit: Column, place: str, block_bits: int) -> DataFrame:
    """Rows with their places after a stable counting sort by one digit."""
    block, at, count = f"{OWN}block", f"{OWN}digit", f"{OWN}count"
    base, before, first = f"{OWN}base", f"{OWN}before", f"{OWN}first"
    placed = rows.withColumns({block: F.shiftright(place, block_bits), at: digit})
    counts = placed.groupBy(block, at).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(at).agg(F.sum(count).alias(count))  # as many rows as digits
    bases = totals.select(at, F.coalesce(F.sum(count).over(earlier.orderBy(at)), F.lit(0)).alias(base))
    offsets = counts.withColumn(
        before, F.coalesce(F.sum(count).over(earlier.partitionBy(at).orderBy(block)), F.lit(0))
    ).join(bases, at).select(block, at, (F.col(base) + F.col(before)).alias(first))
    inside = F.row_number().over(Window.partitionBy(block, at).orderBy(place)) - 1
    return (
        placed.withColumn(f"{OWN}inside", inside).join(offsets, [block, at])
        .withColumn(place, F.col(first) + F.col(f"{OWN}inside")).select(*rows.columns))


def radix_ranks(
    rows: DataFrame, keys: list[tuple[str, bool]], out: str, digit_bits: int = DIGIT_BITS,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Adds the rank of each row from 0 without gaps; key columns are longs without nulls.

    Rows equal in all keys keep the order they have when first stored. Each pass is written to the shared folder.
    """
    placed = written_once(rows.withColumn(out, F.monotonically_increasing_id()))
    # A pass by a digit that all rows share makes places gapless.
    for digit in digits(placed, keys, digit_bits) or [F.lit(0).cast("bigint")]:
        placed = written_once(counting_pass(placed, digit, out, block_bits))
    return placed
