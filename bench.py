"""Headline queries, timed. One JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from lagmill.session import build_session

HEADLINE = (
    "flagship_benchmark_scores", "t8_j3_transform_by_code", "t9_make_stationary", "a1_a18_describe_panel",
    "a1_describe_facts", "a9_quantiles_of_large_groups", "a14_histogram", "a15_acf", "d1_adf", "s3_pair_correlations",
    "s4_screened_selection", "w1_w3_w4_lag_features", "w5_w6_second_grain", "w7_w8_forecast_origins",
    "a9_a10_f18_limits_and_scales", "a4_a5_score_table", "m10_m3_m9_backtest_forecasts", "m5_huber_backtest",
    "m4_multivariate_elastic_net_backtest", "a6_r4_importance", "a17_dependence_curve", "r2_explanation_matrix",
)
ROUNDS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(HEADLINE[0])
    seconds = {name: min(run(name) for _ in range(ROUNDS)) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
