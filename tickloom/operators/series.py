"""Ordered per-instrument computation without ever gathering one instrument in one task.

A series is cut into calendar blocks of ``span_days``. With at most one row per instrument and
date a block holds at most ``span_days`` rows, however long or hot its series is, and the rows are
shuffled once, by (instrument, block). What a frame needs from outside its block is delivered to
it from the tails of the blocks, a small fraction of the rows:

* the last ``rows`` rows before the block, for bounded frames;
* running values over all blocks before it, over all blocks, or over those after it, for
  unbounded frames, row positions and row counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

BLOCK = "_block"
IS_HISTORY = "_is_history"
SPAN_DAYS = 1024


@dataclass(frozen=True)
class Series:
    """How rows are keyed, ordered and cut into blocks."""

    key: str = "stock_id"
    order: str = "trade_date"
    span_days: int = SPAN_DAYS

    @property
    def in_block(self) -> WindowSpec:
        """Rows of one block, and of its history if it was added, in time order."""
        return W.partitionBy(self.key, BLOCK).orderBy(self.order)

    def blocked(self, df: DataFrame) -> DataFrame:
        """Rows shuffled by instrument and block; rows that already are stay where they are."""
        if BLOCK in df.columns:
            return df
        day = F.unix_date(F.to_date(self.order))
        block = F.floor(day / F.lit(self.span_days)).cast("int")
        return df.withColumn(BLOCK, block).repartition(self.key, BLOCK)

    def extended(
        self,
        blocked: DataFrame,
        rows: int = 0,
        totals: Mapping[str, Column] | None = None,
        before: Mapping[str, Column] | None = None,
        overall: Mapping[str, Column] | None = None,
        after: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Blocks with their history and with values carried over from other blocks.

        ``rows`` rows before each block are copied into it, marked by ``IS_HISTORY``. ``totals``
        aggregates a block; ``before``, ``overall`` and ``after`` aggregate these totals, skipping
        NULLs, over the blocks before, all blocks, and the blocks after, and become columns.

        Among block tails, a row precedes a later block by at most ``rows`` rows exactly if some
        row of that block is among its next ``rows`` tail rows; sparse blocks are thereby skipped
        over correctly. A block's carried values travel as one extra row of it, without other
        values, that sorts first. It too is marked by ``IS_HISTORY``: frames skip its NULLs, and the
        caller drops all marked rows once its frames are computed.
        """
        key, order, data = self.key, self.order, [c for c in blocked.columns if c != BLOCK]
        totals = totals or {}
        by_block = W.partitionBy(key).orderBy(BLOCK)
        frames = [
            (before, by_block.rangeBetween(W.unboundedPreceding, -1)),
            (overall, W.partitionBy(key)),
            (after, by_block.rangeBetween(1, W.unboundedFollowing)),
        ]
        carried = {name: value.over(frame) for values, frame in frames
                   for name, value in (values or {}).items()}

        block = W.partitionBy(key, BLOCK)
        rank = F.row_number().over(block.orderBy(F.desc(order)))
        is_last = F.col("_rank") == 1
        tails = (
            blocked.withColumns({"_rank": rank, **{n: e.over(block) for n, e in totals.items()}})
            .where(F.col("_rank") <= max(rows, 1))
            .withColumns({n: F.when(is_last, F.col(n)) for n in totals})
        )
        targets = F.array().cast("array<int>")
        if rows:
            following = W.partitionBy(key).orderBy(BLOCK, order).rowsBetween(1, rows)
            targets = F.array_except(F.collect_set(BLOCK).over(following), F.array(BLOCK))
        if carried:
            targets = F.concat(targets, F.when(is_last, F.array(BLOCK)).otherwise(
                F.array().cast("array<int>")))
        to_self = F.col("_target") == F.col(BLOCK)
        extra = (
            tails.withColumns({**carried, "_targets": targets})
            .withColumn("_target", F.explode("_targets"))
            .select(
                key,
                *[F.when(~to_self, F.col(c)).alias(c) for c in data if c != key],
                F.col("_target").alias(BLOCK), F.lit(True).alias(IS_HISTORY),
                *[F.when(to_self, F.col(c)).alias(c) for c in carried])
            .repartition(key, BLOCK)
        )
        types = dict(extra.dtypes)
        own = blocked.withColumns({
            IS_HISTORY: F.lit(False), **{c: F.lit(None).cast(types[c]) for c in carried}})
        merged = own.unionByName(extra)
        if not carried:
            return merged
        so_far = self.in_block.rowsBetween(W.unboundedPreceding, 0)
        return merged.withColumns(
            {c: F.first(c, ignorenulls=True).over(so_far) for c in carried})

    def positions(self, df: DataFrame, position: str = "position", total: str = "total") -> DataFrame:
        """Adds the 1-based row position within the instrument and its row count."""
        counted = self.extended(
            self.blocked(df), totals={"_n": F.count(F.lit(1))},
            before={"_offset": F.sum("_n")}, overall={total: F.sum("_n")})
        # The row that carries the counts comes first in its block.
        place = F.row_number().over(self.in_block) - 1 + F.coalesce("_offset", F.lit(0))
        return own_rows(counted.withColumn(position, place)).drop(BLOCK, "_offset")


def own_rows(extended: DataFrame) -> DataFrame:
    """The rows that a block was not merely lent."""
    return extended.where(~F.col(IS_HISTORY)).drop(IS_HISTORY)
