"""Daily bars kept up to date from a stream of ticks that may come late, in any order, and more than once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.features import refreshed_features
from tickloom.operators.series import Series
from tickloom.plans.mapping import bar_aggregates, tick_order
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import written_once
from tickloom.sinks.tables import read_table, upsert

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_date", T.DateType()),
    *[T.StructField(name, T.DoubleType()) for name in ("open", "high", "low", "close")],
    T.StructField("volume", T.LongType()),
])
FEATURE_SCHEMA = T.StructType([
    *BAR_SCHEMA.fields[:2], *[T.StructField(name, T.DoubleType()) for name in FEATURE_COLUMNS]])
TICK_SCHEMA = "symbol string, ts timestamp, value double, event_id bigint, trade_date date"
BAR_KEY = ("symbol", "trade_date")
FILES_PER_TRIGGER = 64


def read_ticks(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """A tick table, one file or a folder of them, as a stream of symbol, ts, value and event_id.

    A batch takes a bounded number of files, so that a backlog is worked off in several.
    """
    # As a pattern the path may name a file; only folders may be named without one.
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(
        f"{path[:-1]}[{path[-1]}]")
    return ticks.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("double").alias("value"), F.col("event_id").cast("bigint").alias("event_id"))


def _event() -> Column:
    """What names a tick: its id, or all of it where it has none."""
    return F.when(F.col("event_id").isNull(), F.struct("ts", "value"))


def bars_of(ticks: DataFrame) -> DataFrame:
    """One bar per symbol and day; copies of a tick count once."""
    once = ticks.where(F.col("trade_date").isNotNull()).withColumn("_event", _event()).dropDuplicates(
        ["symbol", "trade_date", "event_id", "_event"])
    # Of ticks of one time, those without an id come first.
    numbered = once.withColumn("event_id", F.coalesce("event_id", F.lit(-1).cast("bigint")))
    return numbered.withColumn("tick_order", tick_order("ts")).groupBy("symbol", "trade_date").agg(
        *bar_aggregates("value", "tick_order", F.count(F.lit(1))))


def read_stored_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The stored ticks, laid out by day."""
    try:
        return spark.read.schema(TICK_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TICK_SCHEMA)


def upsert_batch(bars_path: str, features_path: str | None = None):
    """A batch writer that merges changed bars by symbol and day, and the features they change.

    Replaying a batch changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = written_once(batch.withColumn("seq", F.lit(batch_id).cast("bigint")))
        upsert(spark, bars_path, rows, BAR_SCHEMA, keys=BAR_KEY)
        since = rows.agg(F.min("trade_date")).first()[0]
        if features_path is None or since is None:
            return
        changed = refreshed_features(
            read_table(spark, bars_path, BAR_SCHEMA), since, Series(key="symbol"))
        upsert(spark, features_path, changed.withColumn("seq", F.lit(0).cast("bigint")),
               FEATURE_SCHEMA, keys=BAR_KEY)

    return write


def tick_batch(ticks_path: str, bars_path: str, features_path: str | None = None):
    """A batch writer that stores the ticks of a batch and brings the bars of their days up to date.

    The days that a batch touches are aggregated again from all their stored ticks, each counted once. So
    neither the order of files nor lateness nor repeated delivery, of a tick, a file or a batch, matters, and
    nothing is held in memory between batches.
    """
    bars = upsert_batch(bars_path, features_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = written_once(batch.withColumn("trade_date", F.to_date("ts")))
        # One value per calendar day touched, which bounds this list.
        days = [r[0] for r in new.select("trade_date").distinct().collect() if r[0] is not None]
        if not days:
            return
        new.hint("rebalance", "trade_date").write.partitionBy("trade_date").mode("append").parquet(ticks_path)
        touched = read_stored_ticks(spark, ticks_path).where(F.col("trade_date").isin(days))
        bars(bars_of(touched), batch_id)

    return write


def stream_upsert(
    ticks: DataFrame, bars_path: str, checkpoint: str, features_path: str | None = None,
    ticks_path: str | None = None,
) -> StreamingQuery:
    """Processes all ticks available, in batches, and stops; run again for those that came since.

    Ticks are stored beside the bars unless a path is given.
    """
    return (
        ticks.writeStream.outputMode("append")
        .foreachBatch(tick_batch(ticks_path or f"{bars_path}-ticks", bars_path, features_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
