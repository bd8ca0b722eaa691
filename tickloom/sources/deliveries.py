"""Feeds from several sources of which any may fail: whole files, single lines, or single payloads.

What cannot be read goes to a quarantine table instead of getting lost, and an instrument whose delivery from one
source is broken is taken from the next, as one is that the source has no rows of.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.schemas import CANDLE_PAYLOAD, HISTORY_FILE, OHLCV
from tickloom.session import written_once
from tickloom.sources.payloads import history_bars, parse_candles

BROKEN = "_broken"
FAULTS = "source string, file string, symbol string, reason string, record string"
BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


@dataclass(frozen=True)
class Source:
    """A place that deliveries land at; ``kind`` is candles (payload lines), csv or json (history files)."""

    name: str
    path: str
    kind: str
    #: Whether each CSV file begins with the names of its columns.
    header: bool = True


def _read(spark: SparkSession, source: Source) -> DataFrame | None:
    """The records with their file and, if they cannot be read, the record itself; None without files."""
    schema = "symbol string, payload string" if source.kind == "candles" else HISTORY_FILE
    empty = spark.createDataFrame([], schema).withColumn(BROKEN, F.lit(None).cast("string"))
    reader = spark.read.schema(empty.schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", BROKEN)
    try:
        if source.kind == "csv":
            records = reader.option("header", source.header).csv(source.path)
        else:
            records = reader.json(source.path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return records.withColumn("file", F.input_file_name())


def _faults(source: Source, rows: DataFrame, reason: Column | str, record: Column) -> DataFrame:
    return rows.select(
        F.lit(source.name).alias("source"), F.col("file"), F.col("symbol"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), record.alias("record"))


def read_delivery(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """The bars of a source with their file, and its faults (rows of :data:`FAULTS`).

    Faults are a missing path, lines that do not fit the schema, dates that are none, and payloads that are not
    JSON or whose arrays differ in length. A payload that says there is no data is none.
    """
    records = _read(spark, source)
    if records is None:
        none = spark.createDataFrame([], f"{BARS}, file string")
        return none, spark.createDataFrame(
            [(source.name, source.path, None, "missing path", None)], FAULTS)
    records = written_once(records)
    faults = _faults(source, records.where(F.col(BROKEN).isNotNull()), "broken line", F.col(BROKEN))
    whole = records.where(F.col(BROKEN).isNull())
    if source.kind == "candles":
        parsed = F.from_json("payload", CANDLE_PAYLOAD)
        sizes = F.array_distinct(F.array(*[F.size(parsed[c]) for c in ("t", "o", "h", "l", "c", "v")]))
        reason = (
            F.when(F.col("symbol").isNull(), "no symbol")
            .when(parsed.isNull() | parsed["s"].isNull(), "broken payload")
            .when((parsed["s"] == "ok") & (F.size(sizes) > 1), "uneven payload"))
        judged = written_once(whole.withColumn("_reason", reason))
        payload = F.col("payload")
        bars = parse_candles(judged.where(F.col("_reason").isNull()), keep=("file",))
    else:
        renamed = history_bars(whole, keep=("file",))
        reason = F.when(F.col("symbol").isNull(), "no symbol").when(F.col("date").isNull(), "no date")
        judged = written_once(renamed.withColumn("_reason", reason))
        payload = F.to_json(F.struct("symbol", "date", *OHLCV))
        bars = judged.where(F.col("_reason").isNull()).drop("_reason")
    kinds = [c.split() for c in BARS.split(", ")]
    return bars.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds], "file"), faults.unionByName(_faults(
        source, judged.where(F.col("_reason").isNotNull()), F.col("_reason"), payload))


def deliver(spark: SparkSession, *sources: Source) -> tuple[DataFrame, DataFrame]:
    """The bars of all instruments, each from the first source that delivers it whole, and the quarantine.

    A fault fails the delivery of its symbol, or of all symbols of its file if it names none. The rows of a
    failed delivery are quarantined with the fault, so every record is either used, passed over for an
    earlier source, or listed. An instrument that no source delivers whole has no bars.
    """
    read = [read_delivery(spark, source) for source in sources]
    bars = written_once(reduce(DataFrame.unionByName, [
        b.withColumns({"source": F.lit(s.name), "_priority": F.lit(i)})
        for i, (s, (b, _)) in enumerate(zip(sources, read))]))
    faults = written_once(reduce(DataFrame.unionByName, [f for _, f in read]))
    by_symbol = faults.where(F.col("symbol").isNotNull()).select("source", "symbol")
    files = faults.where(F.col("symbol").isNull()).select("source", "file").distinct()
    by_file = bars.join(files, ["source", "file"], "left_semi").select("source", "symbol")
    failed = written_once(by_symbol.unionByName(by_file).distinct())
    whole = bars.join(failed, ["source", "symbol"], "left_anti")
    first = whole.groupBy("symbol").agg(F.min("_priority").alias("_priority"))
    chosen = whole.join(first, ["symbol", "_priority"], "left_semi")
    lost = bars.join(failed, ["source", "symbol"], "left_semi").select(
        "source", "file", "symbol", F.lit("delivery failed").alias("reason"),
        F.to_json(F.struct("symbol", "date", *OHLCV)).alias("record"))
    return chosen.select("symbol", "date", *OHLCV, "source"), faults.unionByName(lost)
