"""Exposure pairs and study populations, for the whole comparison x outcome grid at once."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.operators.events import in_observation
from twinarm.operators.history import arm_rows

PAIR = ["target_id", "comparator_id"]
MODEL = [*PAIR, "outcome_id"]
ROW = ["treatment", "subject_id", "cohort_start_date"]


def exposure_pairs(
    cohorts: DataFrame,
    comparisons: DataFrame,
    observation_period: DataFrame,
    remove_duplicate_subjects: bool = True,
    first_exposure_only: bool = False,
    washout_days: int = 0,
    study_start: datetime.date | None = None,
    study_end: datetime.date | None = None,
) -> DataFrame:
    """Target and comparator entries of each comparison, with the end of their observation.

    A subject in both arms is removed whatever the dates of the entries; the study dates and the
    washout restrict what is left.
    """
    rows = arm_rows(
        cohorts.select(
            "cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"
        ),
        comparisons.select(*PAIR).distinct(),
    ).drop("cohort_definition_id")
    if first_exposure_only:
        rows = (
            rows.groupBy(*PAIR, "treatment", "subject_id")
            .agg(F.min(F.struct("cohort_start_date", "cohort_end_date")).alias("e"))
            .select(*PAIR, "treatment", "subject_id", "e.*")
        )
    if remove_duplicate_subjects:
        one_arm = (
            rows.groupBy(*PAIR, "subject_id")
            .agg(F.min("treatment").alias("low"), F.max("treatment").alias("high"))
            .filter(F.col("low") == F.col("high"))
            .select(*PAIR, "subject_id")
        )
        rows = rows.join(one_arm, [*PAIR, "subject_id"], "left_semi")
    if study_start is not None:
        rows = rows.filter(F.col("cohort_start_date") >= F.lit(study_start))
    if study_end is not None:
        rows = rows.filter(F.col("cohort_start_date") <= F.lit(study_end))
    observed = in_observation(
        rows.withColumnRenamed("subject_id", "person_id").withColumnRenamed(
            "cohort_start_date", "start_date"
        ),
        observation_period,
    )
    return observed.filter(
        F.date_add("op_start_date", washout_days) <= F.col("start_date")
    ).select(
        *PAIR,
        "treatment",
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        "cohort_end_date",
        "op_end_date",
    )


def outcome_days(outcomes: DataFrame) -> DataFrame:
    """Outcome rows counted per outcome, subject and day."""
    return outcomes.groupBy(
        F.col("cohort_definition_id").alias("outcome_id"),
        "subject_id",
        F.col("cohort_start_date").alias("outcome_day"),
    ).agg(F.count("*").alias("n"))


def with_outcomes(
    pairs: DataFrame,
    grid: DataFrame,
    outcomes: DataFrame,
    risk_window_start: int = 1,
    risk_window_end: int = 730,
    add_exposure_days_to_start: bool = False,
    add_exposure_days_to_end: bool = True,
    prior_outcome_lookback: int = 99999,
) -> DataFrame:
    """Risk window of each entry and, per outcome, prior outcome, event count and first event.

    ``grid`` lists target, comparator and outcome ids. Time at risk ends with observation. One join
    with the outcome days serves the prior-outcome rule, the counts and the first event.
    """
    start_base = "cohort_end_date" if add_exposure_days_to_start else "cohort_start_date"
    end_base = "cohort_end_date" if add_exposure_days_to_end else "cohort_start_date"
    rows = (
        pairs.withColumn("risk_start", F.date_add(start_base, risk_window_start))
        .withColumn(
            "risk_end", F.least(F.date_add(end_base, risk_window_end), F.col("op_end_date"))
        )
        .drop("op_end_date")
        .withColumn(
            "time_at_risk", F.date_diff(F.col("risk_end"), F.col("risk_start")) + F.lit(1)
        )
        .join(F.broadcast(grid), PAIR)
    )
    days = outcome_days(outcomes)
    day = F.col("outcome_day")
    in_window = day.between(F.col("risk_start"), F.col("risk_end"))
    earlier = (day < F.col("risk_start")) & (
        day >= F.date_sub("cohort_start_date", prior_outcome_lookback)
    )
    return (
        rows.join(days, ["outcome_id", "subject_id"], "left")
        .groupBy(
            *MODEL, *ROW, "cohort_end_date", "risk_start", "risk_end", "time_at_risk"
        )
        .agg(
            F.coalesce(F.bool_or(earlier), F.lit(False)).alias("prior_outcome"),
            F.coalesce(F.sum(F.when(in_window, F.col("n"))), F.lit(0)).alias("outcome_count"),
            F.min(F.when(in_window, day)).alias("first_event"),
        )
        .withColumn("days_to_event", F.date_diff(F.col("first_event"), F.col("risk_start")))
        .withColumn(
            "survival_time", F.coalesce(F.col("days_to_event") + 1, F.col("time_at_risk"))
        )
        .drop("first_event")
    )


def study_population(
    pairs: DataFrame,
    grid: DataFrame,
    outcomes: DataFrame,
    remove_prior_outcome: bool = True,
    min_days_at_risk: int = 1,
    **window: int,
) -> DataFrame:
    return at_risk(with_outcomes(pairs, grid, outcomes, **window), remove_prior_outcome, min_days_at_risk)


def at_risk(judged: DataFrame, remove_prior_outcome: bool = True, min_days_at_risk: int = 1) -> DataFrame:
    """The study population among entries that ``with_outcomes`` has judged."""
    rows = judged.filter(~F.col("prior_outcome")) if remove_prior_outcome else judged
    return rows.filter(F.col("time_at_risk") >= min_days_at_risk).drop("prior_outcome")
