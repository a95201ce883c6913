"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridtide.plans import load
from gridtide.session import build_session

HEADLINE = (
    "enstrophy", "vorticity_report", "step_stats", "histogram", "pooled_stats", "normalize", "windowed_samples",
    "periodogram", "welch_spectrum", "line_spectrum", "wavenumber_spectrum", "spacetime_spectrum",
    "field_autocorrelation", "pod_spectrum", "exact_dmd", "spod", "codec_round_trip", "dmd_forecast",
    "delay_dmd_forecast", "latent_forecast", "ensemble_scores", "stability", "full_evaluation", "run_selection",
    "request_counts", "latency_quantiles", "field_store", "table_digest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "gridtide-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    # One small run starts the JVM's code paths and the Python workers.
    queries["line_spectrum"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
