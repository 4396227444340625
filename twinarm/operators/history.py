"""History before index: days since diagnosis, binary flags, Table-1 inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.sources.cdm import Cdm

# Domain id to table, concept column and start-date column.
DOMAIN_TABLES = {
    "condition": ("condition_occurrence", "condition_concept_id", "condition_start_date"),
    "drug": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date"),
    "procedure": ("procedure_occurrence", "procedure_concept_id", "procedure_date"),
    "device": ("device_exposure", "device_concept_id", "device_exposure_start_date"),
    "measurement": ("measurement", "measurement_concept_id", "measurement_date"),
    "observation": ("observation", "observation_concept_id", "observation_date"),
    "specimen": ("specimen", "specimen_concept_id", "specimen_date"),
}


def domain_records(cdm: Cdm, domains: list[str] | None = None) -> DataFrame:
    """Records of all (or the given) domains in one shape; a filter on ``domain`` prunes tables."""
    parts = []
    for domain, (table, concept, start) in DOMAIN_TABLES.items():
        if domains is None or domain in [d.lower() for d in domains]:
            parts.append(
                cdm[table].select(
                    "person_id",
                    F.lit(domain).alias("domain"),
                    F.col(concept).cast("long").alias("concept_id"),
                    F.col(start).alias("start_date"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def first_dates(records: DataFrame, codesets: DataFrame) -> DataFrame:
    """First record of each person in each concept set; ``codesets`` may carry a domain."""
    on = ["concept_id", "domain"] if "domain" in codesets.columns else ["concept_id"]
    return (
        records.join(codesets, on)
        .groupBy("codeset_id", "person_id")
        .agg(F.min("start_date").alias("first_date"))
    )


def days_since_first(cohort: DataFrame, first_date: DataFrame) -> DataFrame:
    """Days from the first qualifying diagnosis to index, for diagnoses strictly before index.

    ``first_date`` holds one row per person. With several entries after that diagnosis the earliest
    one counts; subjects without a diagnosis before index are absent.
    """
    return (
        cohort.join(first_date, F.col("subject_id") == F.col("person_id"))
        .filter(F.col("first_date") < F.col("cohort_start_date"))
        .groupBy("cohort_definition_id", "subject_id")
        .agg(
            F.min(F.date_diff(F.col("cohort_start_date"), F.col("first_date"))).cast("long").alias(
                "score"
            )
        )
    )


def arm_rows(cohort: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Cohort rows once per comparison they take part in, with ``treatment`` 1 for the target.

    ``comparisons`` (target, comparator and any further key such as the outcome) is the short list
    of study arms written down by the caller.
    """
    sides = comparisons.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("target_id").alias("id"), F.lit(1).alias("treatment")),
                F.struct(F.col("comparator_id").alias("id"), F.lit(0).alias("treatment")),
            )
        ).alias("side"),
    ).select(
        *comparisons.columns,
        F.col("side.id").alias("cohort_definition_id"),
        F.col("side.treatment").alias("treatment"),
    )
    return cohort.join(F.broadcast(sides), "cohort_definition_id")


def with_after_match(rows: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """``after_match`` 1 where the subject of the arm is in the matched population."""
    on = [*keys, "treatment", "subject_id"]
    chosen = matched.select(*on).distinct().withColumn("after_match", F.lit(1))
    return rows.join(chosen, on, "left").withColumn(
        "after_match", F.coalesce("after_match", F.lit(0))
    )


def history_flag(entries: DataFrame, first_date: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``(keys, codeset, subject, score)``: 1 with a record strictly before index, else 0.

    ``entries`` carries a ``codeset_id`` per row (one row per entry and history set). A subject
    with two entries can have both scores.
    """
    dated = first_date.select(
        "codeset_id", F.col("person_id").alias("subject_id"), "first_date"
    )
    seen = F.coalesce(F.col("first_date") < F.col("cohort_start_date"), F.lit(False))
    return (
        entries.join(dated, ["codeset_id", "subject_id"], "left")
        .select(*keys, "codeset_id", "subject_id", seen.cast("int").alias("score"))
        .distinct()
    )


def covariate_rows(
    covariate: DataFrame,
    comparisons: DataFrame,
    matched: DataFrame,
    keys: list[str],
    score_column: str | None = None,
    category_column: str | None = None,
) -> DataFrame:
    """Table-1 input of a stored covariate: treatment, after-match flag, score and/or category."""
    wanted = [*keys, "treatment", "subject_id"]
    values = []
    if category_column:
        values.append(F.col(category_column).alias("category"))
    if score_column:
        values.append(F.col(score_column).alias("score"))
    rows = arm_rows(covariate, comparisons).select(*wanted, *values)
    return with_after_match(rows, matched, keys)
