"""Writing the stored tables: id allocation, unique keys, upserts and appends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from tickloom.functions.scalars import known
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import scratch_path, written_once
from tickloom.sinks import versions

PRICE_KEY = ("stock_id", "trade_date")
MONTH = "trade_month"
#: The folder of rows without a date, as Spark names it.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def number_symbols(symbols: DataFrame, start: Column | int = 0) -> DataFrame:
    """Consecutive ids after ``start``, in symbol order.

    Symbols are range-partitioned, whatever they have in common, and written once, so that their partitions
    stay as they are. They are ranked within partitions; only the counts per partition are summed up in one place.
    """
    parted = written_once(
        symbols.select("symbol").where(F.col("symbol").isNotNull()).distinct()
        .repartitionByRange("symbol").withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    smaller = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_o"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy("symbol"))
    base = F.lit(start) if isinstance(start, int) else start
    return parted.withColumn("_rank", rank).join(offsets, "_part").select(
        (base + F.col("_o") + F.col("_rank")).cast("int").alias("stock_id"), "symbol")


def ensure_stocks(stocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stock table with new symbols added under the next ids; known symbols stay as they are.

    ``wanted`` has symbol and company_name, one row per symbol.
    """
    new = wanted.join(stocks, "symbol", "left_anti")
    highest = stocks.agg(F.coalesce(F.max("stock_id"), F.lit(0))).first()[0]
    added = number_symbols(new, highest).join(new, "symbol")
    columns = ["stock_id", "symbol", "company_name"]
    return stocks.select(columns).unionByName(added.select(columns))


def key_violations(df: DataFrame, keys: Sequence[str] = PRICE_KEY) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def assert_unique_key(df: DataFrame, keys: Sequence[str] = PRICE_KEY) -> DataFrame:
    if not key_violations(df, keys).isEmpty():
        raise ValueError(f"duplicate keys in ({', '.join(keys)})")
    return df


def newest_rows(rows: DataFrame, keys: Sequence[str] = PRICE_KEY, seq: str = "seq") -> DataFrame:
    """The row of each key with the highest ``seq``.

    An aggregate: the copies of a key shrink before the shuffle, so a heavily repeated key costs
    no more than others. Rows that tie in ``seq`` are ordered by their values, and one of them is
    taken as a whole.
    """
    values = [c for c in rows.columns if c not in (*keys, seq)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(seq, *values)).alias("last"))
    return last.select(*[
        F.col(c) if c in keys else F.col("last")[c].alias(c) for c in rows.columns if c != seq])


def merge_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = PRICE_KEY, seq: str = "seq"
) -> DataFrame:
    """Existing rows overwritten by incoming ones on equal keys.

    Among incoming copies of a key the one with the highest ``seq`` (not negative) wins.
    """
    rows = existing.withColumn(seq, F.lit(-1).cast("bigint")).unionByName(
        incoming.select(*existing.columns, F.col(seq).cast("bigint").alias(seq)))
    return newest_rows(rows, keys, seq)


def read_table(
    spark: SparkSession, path: str, schema: StructType,
    first: dt.date | None = None, last: dt.date | None = None, date: str = "trade_date",
) -> DataFrame:
    """A stored table, empty if nothing was written yet.

    ``first`` and ``last`` bound the dates; of tables laid out by month other months are not read. Of a table
    with versions, the newest when this is called is read, whatever is published afterwards.
    """
    version = versions.newest(spark, path)
    folders = None if version is None else [
        folder for month, folder in sorted(version.folders.items())
        if (first is None or first.replace(day=1).isoformat() <= month != NO_MONTH)
        and (last is None or month <= last.replace(day=1).isoformat())]
    try:
        rows = spark.createDataFrame([], schema) if folders == [] else spark.read.schema(schema).parquet(
            *([path] if folders is None else [f"{path}/{folder}" for folder in folders]))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    if first is not None:
        rows = rows.where(F.col(date) >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col(date) <= F.lit(last))
    return rows.select(*schema.fieldNames())


def month_of(column: Column | str = "trade_date") -> Column:
    return F.trunc(column, "month")


def newest_or_tied(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row of each key with the highest ``seq``, and whether unequal rows share it (``_tied``)."""
    values = [c for c in rows.columns if c not in (*keys, seq)]
    last = rows.groupBy(*keys).agg(
        F.max(F.struct(seq, *values)).alias("last"),
        F.min(F.struct((-F.col(seq)).alias(seq), *values)).alias("other"))
    tied = ~F.struct(*[F.col("last")[c] for c in values]).eqNullSafe(
        F.struct(*[F.col("other")[c] for c in values]))
    return last.select(*[
        F.col(c) if c in keys else F.col("last")[c].alias(c) for c in rows.columns if c != seq],
        tied.alias("_tied"))


def upsert(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    schema: StructType,
    keys: Sequence[str] = PRICE_KEY,
    seq: str = "seq",
    date: str = "trade_date",
) -> None:
    """Merges rows into a Parquet table laid out by month, rewriting only the months touched, all or none.

    The incoming rows are computed once, into the shared folder. Of rows with one key that with the highest
    ``seq`` counts; if unequal rows share it, the key is not unique and nothing is written. Merged months are
    written beside those they replace and published together as a new version; until then, readers see the old
    one in full, and a run that is cut short can be repeated. Merging the same rows again changes nothing.
    """
    staged = scratch_path(spark, "upsert")
    tagged = incoming.withColumn(MONTH, month_of(date)).select(*schema.fieldNames(), MONTH, seq)
    newest_or_tied(tagged, [*keys, MONTH], seq).write.parquet(staged)
    staged_rows = spark.read.schema(_with_month(schema).add("_tied", "boolean")).parquet(staged)
    broken = staged_rows.where("_tied").select(*keys).first()
    if broken is not None:
        raise ValueError(f"several rows without order for the key {tuple(broken)}")
    new = staged_rows.drop("_tied")
    # One value per calendar month touched, which bounds this list.
    months = [r[0].isoformat() if r[0] else NO_MONTH for r in new.select(MONTH).distinct().collect()]
    if not months:
        return
    current = versions.newest(spark, path)
    kept = {} if current is None else dict(current.folders)
    replaced = [kept[m] for m in sorted(months) if m in kept]
    if replaced:
        existing = spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in replaced])
        new = merge_rows(existing.withColumn(MONTH, month_of(date)), new.withColumn(seq, F.lit(0)),
                         [*keys, MONTH], seq)
    folder = versions.fresh_folder()
    _by_month(new).write.partitionBy(MONTH).parquet(f"{path}/{folder}")
    versions.publish(spark, path, current, {**kept, **{m: f"{folder}/{MONTH}={m}" for m in months}})


def _with_month(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add(MONTH, "date")


def _by_month(df: DataFrame) -> DataFrame:
    """Gathers months into few files; a month too large for one task is split."""
    return df.hint("rebalance", MONTH)


def upsert_prices(
    spark: SparkSession, path: str, bars: DataFrame, schema: StructType,
    loaded_at: dt.datetime | None = None,
) -> None:
    """Bars by (stock_id, trade_date); an unknown volume is stored as 0."""
    rows = bars.withColumns({
        "volume": F.coalesce("volume", F.lit(0).cast("bigint")), "created_at": stamp(loaded_at)})
    upsert(spark, path, rows, schema)


def upsert_features(
    spark: SparkSession, path: str, features: DataFrame, schema: StructType,
    loaded_at: dt.datetime | None = None,
) -> None:
    rows = features.withColumns({
        **{c: known(c) for c in FEATURE_COLUMNS},
        "created_at": stamp(loaded_at), "seq": F.lit(0).cast("bigint")})
    upsert(spark, path, rows, schema)


def stamp(at: dt.datetime | None) -> Column:
    """The load time, naive UTC."""
    return (F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
            if at is None else F.lit(at)).cast("timestamp_ntz")


def with_created_at(rows: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    given = F.col("created_at") if "created_at" in rows.columns else F.lit(None)
    return rows.withColumn("created_at", F.coalesce(given.cast("timestamp_ntz"), stamp(at)))


def drop_known(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key among new rows whose key is not stored yet."""
    values = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_row"))
    return once.select(*keys, "_row.*").join(existing, list(keys), "left_anti")


def append_rows(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    schema: StructType,
    at: dt.datetime | None = None,
    dedupe_on: Sequence[str] | None = None,
) -> None:
    """Appends predictions or anomalies; repeated runs repeat rows unless ``dedupe_on`` is given."""
    stamped = with_created_at(rows, at).select(*schema.fieldNames())
    if dedupe_on:
        stamped = drop_known(stamped, read_table(spark, path, schema), dedupe_on).select(
            *schema.fieldNames())
    stamped.write.mode("append").parquet(path)
