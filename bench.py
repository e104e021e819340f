"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import QUERIES, build
from tidemark.session import clear_scratch, local_session

HEADLINE = [
    "a05_equal_shards", "c05_panel_build", "c08_id_lookup", "d01_daily_market_summary", "d06_executive_aggregates",
    "d09_size_summary_quantile", "d10_market_decile_summary", "d11_stock_decile_summary", "d12_by_total_count",
    "d13_describe_by_group", "d15_weekly_resample", "d17_weekly_rollup", "d19_mode_per_date", "d22_skew_kurtosis",
    "d24_histogram_all", "d25_correlations", "d29_category_counts_by_sign", "e03_rolling_means", "e06_quantile_bins",
    "e07_rank_groups", "e08_drop_outliers", "e09_standardise", "e11_compounded", "e12_tenure", "e13_rank_predictions",
    "h02_mann_whitney", "h03_welch_t_test", "h04_dummy_test_table", "i05_lasso", "j03_all_strategies",
    "j08_against_benchmark", "k01_long_lines", "k04_topic_sentences", "k05_headline_sentiment", "k08_culture_counts",
    "l01_news_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    build("d01_daily_market_summary", spark, folder).count()  # start-up work is not part of any query
    times = {}
    for name in chosen:
        if name not in QUERIES:
            continue
        start = time.perf_counter()
        build(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
