"""Money flow and the 14-day money flow index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.features import BARS
from tickloom.operators.series import Series, own_rows

MFI_ROWS = 14
MIN_ROWS = 15
NEUTRAL_MFI, OVERBOUGHT, OVERSOLD = 50.0, 80, 20

FLOW_COLUMNS = (
    "typical_price", "raw_money_flow", "flow_direction", "inflow", "outflow", "mfi_14",
    "net_flow", "cumulative_flow",
)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def flow_direction(series: Series) -> Column:
    """1 for a rise of the typical price, -1 for a fall, otherwise 0."""
    previous = F.lag("typical_price").over(series.in_block)
    now = F.col("typical_price")
    return F.when(now > previous, 1).when(now < previous, -1).otherwise(0)


def money_flow_index(inflow: Column, outflow: Column) -> Column:
    """NULL where nothing flowed out."""
    return 100 - ratio(F.lit(100.0), 1 + ratio(inflow, outflow))


def compute_capital_flow(
    prices: DataFrame, series: Series = BARS, keep: tuple[str, ...] = (),
    rolling_sums: bool = False,
) -> DataFrame:
    """Flow columns of every bar, for instruments with at least fifteen bars.

    ``keep`` names input columns to pass on; ``rolling_sums`` adds the sums behind the index.
    """
    sums = ("inflow_14", "outflow_14")
    bars = series.blocked(prices.select(
        series.key, series.order, "high", "low", "close", "volume",
        *[c for c in keep if c not in ("high", "low", "close", "volume")]))
    w = series.in_block
    recent = w.rowsBetween(1 - MFI_ROWS, 0)

    # One more row of history than the frame is long: the oldest row needs its own predecessor.
    flows = own_rows(
        series.extended(
            bars, MFI_ROWS, {"_n": F.count(F.lit(1))}, overall={"_rows": F.sum("_n")})
        .withColumn("typical_price", typical_price())
        .withColumn("raw_money_flow", F.col("typical_price") * F.col("volume"))
        .withColumn("flow_direction", flow_direction(series))
        .withColumn("inflow", F.when(F.col("flow_direction") == 1, F.col("raw_money_flow"))
                    .otherwise(0.0))
        .withColumn("outflow", F.when(F.col("flow_direction") == -1, F.col("raw_money_flow"))
                    .otherwise(0.0))
        .withColumn("net_flow", F.col("inflow") - F.col("outflow"))
        .withColumns({
            "inflow_14": F.sum("inflow").over(recent),
            "outflow_14": F.sum("outflow").over(recent)})
        .withColumn("mfi_14", money_flow_index(F.col("inflow_14"), F.col("outflow_14")))
    ).where(F.col("_rows") >= MIN_ROWS)
    running = F.sum("net_flow").over(w.rowsBetween(W.unboundedPreceding, 0))
    return own_rows(
        series.extended(
            flows, totals={"_net": F.sum("net_flow")}, before={"_net_before": F.sum("_net")})
        .withColumn("cumulative_flow", running + F.coalesce("_net_before", F.lit(0.0)))
    ).select(series.key, series.order, *keep, *FLOW_COLUMNS, *(sums if rolling_sums else ()))


def flow_kpis(flows: DataFrame) -> DataFrame:
    """Per instrument: total flows and the latest index, 50 standing in for an unknown one."""
    totals = flows.groupBy("stock_id").agg(
        F.sum("inflow").alias("total_inflow"),
        F.sum("outflow").alias("total_outflow"),
        F.coalesce(F.max_by("mfi_14", "trade_date"), F.lit(NEUTRAL_MFI)).alias("mfi_latest"),
    )
    return totals.withColumn("net_total", F.col("total_inflow") - F.col("total_outflow"))


def mfi_signal(mfi: Column | str = "mfi_latest") -> Column:
    value = F.col(mfi) if isinstance(mfi, str) else mfi
    return (
        F.when(value > OVERBOUGHT, "Overbought").when(value < OVERSOLD, "Oversold")
        .otherwise("Neutral")
    )


def net_flow_sign(net: Column | str = "net_total") -> Column:
    value = F.col(net) if isinstance(net, str) else net
    return F.when(value > 0, "Positive").otherwise("Negative")


def flow_series(flows: DataFrame) -> DataFrame:
    """Net and cumulative flow per day, with the sign of the last cumulative value."""
    last = flows.groupBy("stock_id").agg(
        F.max_by("cumulative_flow", "trade_date").alias("_last"))
    return (
        flows.select("stock_id", "trade_date", "net_flow", "cumulative_flow")
        .join(last, "stock_id")
        .withColumn("trend", F.when(F.col("_last") >= 0, "up").otherwise("down"))
        .drop("_last")
    )
