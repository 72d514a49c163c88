"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from birthwave.operators import lms, mixed
from birthwave.params import Params
from birthwave.plans import centiles, growth, queries
from birthwave.operators.impute import impute_and_shift
from birthwave.plans.survey import clean_table
from birthwave.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "200"))
    wanted = set(sys.argv[1:])
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    params = Params(bootstrap_reps=reps)

    def clean():
        return clean_table(spark, sf_dir)

    def lms_fit():
        coef, curves = centiles.cohort_centiles(clean(), reps, params)
        return lms.lms_centiles(curves, ["cohort", "stratum", "age"])

    runs = {
        "clean_table": clean,
        "harmonised_by_year": lambda: queries.harmonised_by_year(spark, sf_dir),
        "weighted_mean_by_stratum": lambda: queries.weighted_mean_by_stratum(spark, sf_dir),
        "bootstrap_mean_interval": lambda: queries.poisson_mean_ci(spark, sf_dir),
        "exact_bootstrap_interval": lambda: queries.bootstrap_mean_ci(spark, sf_dir),
        "missing_two_factor": lambda: queries.missing_two_factor_ols(spark, sf_dir),
        "given_centile_intervals": lambda: queries.lms_centiles(spark, sf_dir),
        "mixed_models_36": lambda: growth.specification_results(clean(), mixed.spec_grid(), params)["trajectories"],
        "imputation_pattern_mixture": lambda: impute_and_shift(clean(), params)[1],
        f"lms_fit_{reps}": lms_fit,
    }
    seconds = {}
    for name, run in runs.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 2), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
