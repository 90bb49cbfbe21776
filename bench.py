"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line.  Each query is fully materialised with the ``noop`` sink (every column
computed, nothing collected to the driver).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES ("headline" (default), "all", or a comma-separated list),
BENCH_DRAWS (draws for the rate-throughput probe, default 1000),
BENCH_REPEAT (runs per query, the median is reported; default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "empirical_rate", "freeze_summary", "slope_coverage", "dispersion_index", "spline_basis",
    "rate_draws_gamma_weibull", "rate_quantiles", "loglik_variable", "log_prior_rw", "log_score",
    "central_errors", "predictive_sampled", "split_rhat", "parameter_summary", "ess", "is_loo", "psis_loo",
    "corrected_looic", "looic_grid", "run_assessment",
]


def main() -> None:
    from pyspark.sql import functions as F

    from cohortcast.config import FIXTURE
    from cohortcast.operators.draws import rate_draws
    from cohortcast.plans.registry import all_queries
    from cohortcast.session import local_session
    from cohortcast.sources import fixtures as fx

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    which = os.environ.get("BENCH_QUERIES", "headline")
    n_draws = int(os.environ.get("BENCH_DRAWS", "1000"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="cohortcast-bench")
    reg = all_queries()
    names = list(reg) if which == "all" else HEADLINE if which == "headline" else which.split(",")

    # warm-up (JVM JIT, parquet footers): materialise the cells view once
    fx.cells(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    t_all = time.time()
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.time()
            reg[name].spark_df(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
    total = sum(times.values()) if repeat > 1 else time.time() - t_all

    # rate-draw throughput (J11): n_draws x 50 cohorts x 50 ages x 5 countries rows
    cfg = FIXTURE.with_(n_draws=n_draws)
    rd = rate_draws(fx.draws(spark, sf_dir, cfg), cfg, ("gamma_density", "weibull_density"))
    t0 = time.time()
    n_rows = rd.agg(F.count(F.lit(1)).alias("n"), F.sum("Rate").alias("s")).collect()[0]["n"]
    rd_sec = time.time() - t0

    # likelihood throughput (J14): pointwise log likelihood at n_draws draws
    from cohortcast.operators.likelihood import loglik
    from cohortcast.plans.q_prep import small_grid, small_obs

    ll = loglik(fx.draws(spark, sf_dir, cfg), small_grid(spark, sf_dir), small_obs(spark, sf_dir),
                fx.dispersion(spark, sf_dir, cfg), cfg, "variable", ("gamma_density", "weibull_density"))
    t0 = time.time()
    n_ll = ll.agg(F.count(F.lit(1)).alias("n"), F.sum("ll").alias("s")).collect()[0]["n"]
    ll_sec = time.time() - t0

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
        "rate_draw_rows": int(n_rows),
        "rate_draw_rows_per_sec": round(n_rows / rd_sec, 1),
        "loglik_rows": int(n_ll),
        "loglik_sec": round(ll_sec, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
