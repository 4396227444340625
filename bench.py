"""Headline queries, timed on one machine; prints one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the warm runs per query.
The stage tables (records, eras, cohorts, covariates, population) are built first and timed on their
own; every query is then run once to warm up and reported as the median of the runs after that.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks import catalog, design, feature_queries, study_queries
from checks.compare import local_session
from checks.registry import study_for

HEADLINE = (
    "v5_codesets",
    "c2_first_ever",
    "c12_presence",
    "c13_nested",
    "c21_drug_arm",
    "c22_procedure_arm",
    "c25_outcome_composite",
    "c26_negative_controls",
    "f4_chads2vasc",
    "f6_days_summary",
    "f7_history_flag",
    "x3_condition_windows",
    "x5_condition_groups",
    "x7_drug_eras",
    "p5_study_population",
    "p9_match_exact",
    "p9_match_caliper",
    "p10_match_ratio",
    "p11_balance",
    "m1_cox_pairs",
    "m2_cox_iterative",
    "m2_cox_covariate",
    "m8_null_grid",
    "m9_calibrated_p",
    "r1_km",
    "t7_table1",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    study = study_for(spark, sf_dir)
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        started = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - started, 3)

    timed("stage_tables", lambda: [
        study.cdm[t] for t in ("concept", "concept_ancestor", "observation_period", "condition_era", "drug_era")
    ])
    timed("stage_cohorts", lambda: design.cohorts(study))
    timed("stage_covariates", lambda: feature_queries.covariates(study))
    timed("stage_population", lambda: study_queries.scored(study))
    # Ten folds by ten repetitions for every variance tried: once, cold.
    timed("p6_propensity", lambda: catalog.QUERIES["p6_propensity"](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in HEADLINE:
        def run() -> None:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        spent = []
        for _ in range(runs):
            started = time.perf_counter()
            run()
            spent.append(time.perf_counter() - started)
        times[name] = round(statistics.median(spent), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, warm median, plus stage builds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": spark.sparkContext.defaultParallelism,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
