"""Times the headline queries: python bench.py prints one line of JSON.

$BENCH_SF_DIR is the folder of tables, $BENCH_CPUS the number of local cores. Each query runs once to warm up and is then
timed over its whole result, written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "signal_rollup_verdict", "window_seven_stats", "sliding_windows", "perclos_ring", "rolling_dispersion_holdover", "detrended_sway",
    "range_join_audio", "asof_hold_join", "interval_overlap_join", "personal_baselines", "sprt_latch", "ema_fold", "roc_auc", "youden_threshold",
    "array_ear", "autocorr_pitch", "dft_band_power", "channel_equi_join",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from kymora.plans.catalogue import QUERIES

    times: dict[str, float] = {}
    for name in HEADLINE:
        run = QUERIES[name][0]
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
