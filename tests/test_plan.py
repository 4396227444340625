import os

import pytest
from pyspark.sql import functions as F

from checks import design, study_queries
from checks.feature_queries import covariates
from checks.registry import study_for
from twinarm.operators.population import MODEL
from twinarm.plans.study import StudySettings, calibrated_summary, run_analysis

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_whole_study(spark, tmp_path):
    study = study_for(spark, SF)

    def run(outcomes, ids, stages):
        return run_analysis(
            design.arms(study),
            outcomes,
            study_queries.grid(study, ids),
            study.cdm["observation_period"],
            covariates(study),
            StudySettings(caliper=0.5),
            str(tmp_path / stages),
            score=lambda rows: study_queries.cell_scores(study, rows),
        )

    main = run(study_queries.outcome_rows(study), design.OUTCOMES, "main")
    controls = run(design.control_cohorts(study), design.CONTROLS, "controls")
    assert sorted(os.listdir(tmp_path / "main")) == ["attrition", "balance", "matched", "population", "ps", "summary"]
    kept = main.matched.groupBy(*MODEL).agg(
        F.count("*").alias("n"), F.count_distinct("stratum_id").alias("s")
    )
    assert kept.count() > 0 and kept.filter("n <> 2 * s").isEmpty()
    steps = main.attrition.groupBy(*MODEL, "treatment").pivot("step", [0, 1, 2, 3, 4]).agg(F.first("subjects")).collect()
    assert steps and all(r["0"] >= r["1"] >= r["2"] >= r["3"] >= r["4"] > 0 for r in steps)
    total = calibrated_summary(main.summary, controls.summary, design.control_ids(study)).collect()
    assert all(0 <= r.calibrated_p <= 1 for r in total)
