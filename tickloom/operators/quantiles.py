"""Exact quantiles per group without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.operators.joins import join_per_stock
from tickloom.session import written_once

BUCKETS = 4096


def _narrowed(rows: DataFrame, brackets: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """Brackets replaced by the least and greatest value of the bucket that holds the rank they look for."""
    wanted = brackets.groupBy(key).agg(F.collect_list(F.struct("rank", "low", "high", "before")).alias("_b"))
    inside = (
        join_per_stock(rows, wanted, [key]).withColumn("_b", F.explode("_b")).select(key, value, "_b.*")
        .where((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high"))))
    # Halves, so that the width of a bracket is finite.
    share = (F.col(value) / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    histogram = inside.withColumn("_bucket", F.floor(share * (buckets - 1)).cast("int")).groupBy(
        key, "rank", "before", "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("low"), F.max(value).alias("high"))
    smaller = W.partitionBy(key, "rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = histogram.withColumn("before", F.col("before") + F.coalesce(F.sum("_n").over(smaller), F.lit(0)))
    holds = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("_n"))
    return counted.where(holds).select(key, "rank", "low", "high", "before")


def exact_quantile(
    rows: DataFrame, key: str, value: str, share: float, buckets: int = BUCKETS
) -> DataFrame:
    """The linearly interpolated quantile ``share`` of ``value`` per ``key``; null values do not count.

    A bracket around each of the two order statistics is narrowed, for all keys in step, to the values of
    one of ``buckets`` equal parts, until its ends are equal. Values are only counted: no group is sorted or
    ranked, however many of its values are equal or lie close together beside a far one. The least and the
    greatest value of a bracket fall into different parts, so each round narrows every open bracket.
    """
    known = rows.select(key, value).where(F.col(value).isNotNull())
    at = (F.col("_n") - 1) * F.lit(share)
    brackets = written_once(
        known.groupBy(key).agg(
            F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("_n"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
        .select(key, "rank", "low", "high", F.lit(0).cast("bigint").alias("before"),
                at.alias("_at")))
    places = brackets.select(key, "_at").distinct()
    found: list[DataFrame] = []
    brackets = brackets.drop("_at")
    while True:
        found.append(brackets.where("low = high"))
        still = brackets.where("low < high")
        if still.isEmpty():
            break
        brackets = written_once(_narrowed(known, still, key, value, buckets))
    closed = found[0]
    for part in found[1:]:
        closed = closed.unionByName(part)

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("low")))

    low, high = F.col("_lower"), F.col("_upper")
    return (
        closed.join(places, key).groupBy(key, "_at")
        .agg(value_at(F.floor("_at")).alias("_lower"), value_at(F.ceil("_at")).alias("_upper"))
        .select(key, (low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
    )
