"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fc_seasonal_anchor", "pipe_quality", "agg_quality_report", "pipe_features_v4", "pipe_features_v5", "pipe_features_hourly", "win_rolling_excl", "win_rolling_median",
    "win_outlier_rolling", "win_impute", "join_interval_mask", "join_asof_price", "agg_block_mape", "agg_cohort_rollup", "agg_point_metrics_ext", "agg_linear_fit",
    "prj_quality_score", "set_dedupe_latest", "split_rolling_origin", "dsp_greedy_day", "dsp_size_sweep", "eco_irr_heatmap", "net_neighborhood", "fit_meter_model", "fc_recursive", "st_dedupe",
]


def main() -> None:
    from wattloom.catalog import QUERIES
    from wattloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, quiet=True)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["fc_seasonal_anchor"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and the Python workers
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
