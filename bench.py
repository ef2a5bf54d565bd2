"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetpulse.catalog.queries import QUERIES
from fleetpulse.session import build_session

HEADLINE = [
    "scan_range",
    "ingest_validate",
    "counter_rates",
    "feat_lags",
    "feat_rolling",
    "feat_ema",
    "feat_slope",
    "feat_burst",
    "features_all",
    "scaler_fit",
    "chrono_split",
    "forest_sample",
    "train_summary",
    "forest_score",
    "detect_batch",
    "classification_report",
    "roc_curve",
    "pr_curve",
    "lead_time",
    "inject_anomalies",
    "forecast_multi_metric",
    "alerts_cooldown",
    "history_last_n",
    "metric_histogram",
    "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
