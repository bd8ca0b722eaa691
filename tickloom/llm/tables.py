"""Helpers shared by the operators: given tables, ranks without gathering, stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tickloom.session import written_once

#: Prefix of the columns that operators add for their own use.
OWN = "__"

#: Bits of the broadcast filter (1 MB), and of one of its rows.
FILTER_BITS = 1 << 23
ROW_BITS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_number_within(
    rows: DataFrame, group: str, order: list[Column], out: str
) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in the given order.

    No group is gathered: rows are range-partitioned by group and order, so that a large group spans
    many partitions, and numbered inside partitions; each then adds what the partitions before it
    hold, which takes one small row for each group and partition. Rows equal in the whole order may
    come in any order among themselves, and a running number spreads them over partitions.
    """
    own = [f"{OWN}order{i}" for i in range(len(order))]
    block, spread = f"{OWN}block", f"{OWN}spread"
    named = rows.withColumns({
        **dict(zip(own, order)), spread: F.monotonically_increasing_id()})
    stored = written_once(
        named.repartitionByRange(group, *own, spread)
        .withColumn(block, F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(group, block).agg(F.count(F.lit(1)).alias(f"{OWN}rows"))
        .withColumn(f"{OWN}before", F.coalesce(F.sum(f"{OWN}rows").over(before), F.lit(0)))
        .select(F.col(group).alias(f"{OWN}group"), F.col(block).alias(f"{OWN}at"),
                f"{OWN}before"))
    inside = F.row_number().over(Window.partitionBy(group, block).orderBy(*own, spread))
    numbered = stored.withColumn(f"{OWN}inside", inside - 1)
    joined = numbered.join(
        offsets, F.col(group).eqNullSafe(F.col(f"{OWN}group")) & (F.col(block) == F.col(f"{OWN}at")))
    return joined.select(
        *rows.columns, (F.col(f"{OWN}before") + F.col(f"{OWN}inside")).cast("bigint").alias(out))


def may_hold(names: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Rows of ``values`` whose name may be among ``names``; no such row is lost.

    The names become a bit map of fixed size, broadcast in rows of 4 KB. With more names than bits, it
    lets all rows through.
    """
    bit = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    row, at = F.floor(bit / ROW_BITS).cast("int"), (bit % ROW_BITS).cast("bigint")
    bits = names.groupBy(row.alias(f"{OWN}row")).agg(F.bitmap_construct_agg(at).alias(f"{OWN}bits"))
    byte = F.conv(F.hex(F.substring(
        F.col(f"{OWN}bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1
    met = values.join(F.broadcast(bits), row == F.col(f"{OWN}row"))
    return met.where(is_set).drop(f"{OWN}row", f"{OWN}bits")
