"""Provider payloads and history files as raw feed rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.scalars import epoch_to_date
from tickloom.schemas import CANDLE_PAYLOAD, HISTORY_FILE, OHLCV, QUOTE_PAYLOAD


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines ``{"symbol": …, "payload": "…"}``."""
    return spark.read.schema("symbol string, payload string").json(path)


def parse_candles(payloads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bars from parallel-array candle payloads; other statuses and empty answers give no rows."""
    parsed = payloads.select("symbol", *keep, F.from_json("payload", CANDLE_PAYLOAD).alias("p"))
    rows = parsed.where((F.col("p.s") == "ok") & (F.size("p.t") > 0)).select(
        "symbol", *keep,
        F.inline(F.arrays_zip("p.t", "p.o", "p.h", "p.l", "p.c", "p.v")),
    )
    return rows.select(
        "symbol", epoch_to_date("t").alias("date"),
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
        F.col("c").alias("close"), F.col("v").alias("volume"), *keep,
    )


def parse_quotes(payloads: DataFrame) -> DataFrame:
    """Quotes with a non-zero open; a quote carries no volume."""
    q = payloads.select("symbol", F.from_json("payload", QUOTE_PAYLOAD).alias("q"))
    return q.where(F.col("q.o").isNotNull() & (F.col("q.o") != 0)).select(
        "symbol",
        F.col("q.o").alias("open"), F.col("q.h").alias("high"), F.col("q.l").alias("low"),
        F.col("q.c").alias("close"), F.col("q.pc").alias("previous_close"),
        F.lit(None).cast("bigint").alias("volume"), F.col("q.t").alias("timestamp"),
    )


def history_bars(history: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Renames history columns and keeps the wall-clock date of a zoned or plain timestamp."""
    day = F.substring(F.col("Date").cast("string"), 1, 10).try_cast("date")
    return history.select(
        "symbol", day.alias("date"), *[F.col(c.capitalize()).alias(c) for c in OHLCV], *keep)


def read_history(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Bars from history files; ``fmt`` is csv, parquet, orc or json."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(HISTORY_FILE)
    if fmt == "csv":
        reader = reader.option("header", True)
    return history_bars(reader.load(path))


def resolve_sources(*sources: DataFrame) -> DataFrame:
    """All rows of an instrument come from the first source that has any of its rows."""
    ranked = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked)
    chosen = rows.groupBy("symbol").agg(F.min("_priority").alias("_priority"))
    return rows.join(chosen, ["symbol", "_priority"], "left_semi").drop("_priority")
