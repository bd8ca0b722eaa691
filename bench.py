"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tickloom.plans.catalog import QUERIES
from tickloom.session import build_session

HEADLINE = (
    "market_overview", "compute_features", "compute_capital_flow", "clean_stock_data",
    "validate_quality", "period_kpis", "candles_with_ma", "prediction_accuracy", "alert_summary",
    "flow_kpis", "chrono_split", "evaluate", "train_linear", "train_boosted", "train_stacking",
    "predict_next_close",
    "anomaly_flags", "isolation_forest", "upsert_prices", "job_backfill", "stream_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["market_overview"](spark, sf_dir).collect()  # starts the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
