"""Weighted and graded risk scores at index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.operators.reach import near_index
from twinarm.session import small_side

FEMALE = 8532


@dataclass(frozen=True)
class DemographicRule:
    """Weight added for an age range (in completed calendar years) or a gender."""

    category_id: int
    weight: int
    min_age: int | None = None
    max_age: int | None = None
    gender_concept_id: int | None = None


# Category numbers and weights of the two stroke-risk scores. The category named
# "Age>75" counts from 75 on.
CHADS2_WEIGHTS = {1: 1, 2: 1, 4: 1, 5: 2}
CHADS2_DEMOGRAPHICS = (DemographicRule(3, 1, min_age=75),)
CHADS2VASC_WEIGHTS = {1: 1, 2: 1, 4: 1, 5: 2, 6: 1}
CHADS2VASC_DEMOGRAPHICS = (
    DemographicRule(3, 2, min_age=75),
    DemographicRule(7, 1, min_age=65, max_age=74),
    DemographicRule(8, 1, gender_concept_id=FEMALE),
)


def score_categories(
    codesets: DataFrame, category_of: dict[int, int], weights: dict[int, int]
) -> DataFrame:
    """``(category_id, weight, concept_id)`` from the concept sets of the categories."""
    category = F.lit(None).cast("int")
    for codeset, number in category_of.items():
        category = F.when(F.col("codeset_id") == codeset, F.lit(number)).otherwise(category)
    weight = F.lit(None).cast("int")
    for number, value in weights.items():
        weight = F.when(F.col("category_id") == number, F.lit(value)).otherwise(weight)
    return (
        codesets.filter(F.col("codeset_id").isin(*category_of))
        .select(category.alias("category_id"), "concept_id")
        .distinct()
        .withColumn("weight", weight)
        .select("category_id", "weight", "concept_id")
    )


def weighted_score(
    cohort: DataFrame,
    eras: DataFrame,
    person: DataFrame,
    categories: DataFrame,
    demographics: tuple[DemographicRule, ...] = (),
    keep_any_history: bool = False,
    include_zero: bool = False,
) -> DataFrame:
    """Sum of the weights of the categories a subject has on or before index.

    A category counts once per subject and cohort. Subjects without a category are absent, unless
    ``keep_any_history`` keeps those with any earlier era or ``include_zero`` keeps everybody, both
    at score 0. Eras shrink to one first date per person and category before they meet the cohort.
    """
    entries = cohort.select("cohort_definition_id", "subject_id", "cohort_start_date").distinct()
    near = near_index(entries, eras, "condition_era_start_date")
    tagged = near.join(
        small_side(categories),
        F.col("condition_concept_id") == F.col("concept_id"),
        "left" if keep_any_history else "inner",
    )
    first_dates = tagged.groupBy("person_id", "category_id", "weight").agg(
        F.min("condition_era_start_date").alias("first_date")
    )
    keys = ["cohort_definition_id", "subject_id"]
    found = entries.join(
        first_dates,
        (F.col("subject_id") == F.col("person_id"))
        & (F.col("first_date") <= F.col("cohort_start_date")),
    ).select(*keys, "category_id", "weight")

    about = entries.join(
        person.select(
            F.col("person_id").alias("subject_id"), "year_of_birth", "gender_concept_id"
        ),
        "subject_id",
        "left",
    ).withColumn("age", F.year("cohort_start_date") - F.col("year_of_birth"))
    met = []
    for rule in demographics:
        held = F.lit(True)
        if rule.min_age is not None:
            held = held & (F.col("age") >= rule.min_age)
        if rule.max_age is not None:
            held = held & (F.col("age") <= rule.max_age)
        if rule.gender_concept_id is not None:
            held = held & (F.col("gender_concept_id") == rule.gender_concept_id)
        met.append(
            F.when(
                held,
                F.struct(
                    F.lit(rule.category_id).alias("category_id"),
                    F.lit(rule.weight).alias("weight"),
                ),
            )
        )
    if include_zero:
        met.append(
            F.struct(
                F.lit(None).cast("int").alias("category_id"),
                F.lit(None).cast("int").alias("weight"),
            )
        )
    if met:
        rows = about.select(*keys, F.explode(F.array_compact(F.array(*met))).alias("c"))
        found = found.unionByName(rows.select(*keys, "c.category_id", "c.weight"))
    return (
        found.distinct()
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("score"))
    )


def _first_days(records: DataFrame, day: str) -> DataFrame:
    return records.groupBy("person_id", "category_id", "grade").agg(F.min(day).alias("first_day"))


def graded_score(
    cohort: DataFrame,
    eras: DataFrame,
    grades: DataFrame,
    measurements: DataFrame | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Sum over categories of the highest grade a subject has reached on or before index.

    ``grades`` (``category_id, grade, concept_id``) takes condition eras as evidence. ``limits``
    (``category_id, grade, concept_id, low, high``) takes measurements whose value lies below ``low`` or
    above ``high``; a null bound sets none, a record without a value reaches nothing. Both are the
    caller's lists. A lower grade adds nothing to a higher one of its category, whichever kind of
    evidence it comes from. Subjects without evidence are absent.

    Records shrink to one first day per person, category and grade before they meet the cohort.
    """
    keys = ["cohort_definition_id", "subject_id"]
    entries = cohort.select(*keys, "cohort_start_date").distinct()
    tagged = near_index(entries, eras, "condition_era_start_date").join(
        small_side(grades), F.col("condition_concept_id") == F.col("concept_id")
    )
    days = _first_days(tagged, "condition_era_start_date")
    if limits is not None:
        value = F.col("value_as_number")
        beyond = near_index(entries, measurements, "measurement_date").join(
            small_side(limits),
            (F.col("measurement_concept_id") == F.col("concept_id"))
            & ((value < F.col("low")) | ((value > F.col("high")) & ~F.isnan(value))),
        )
        days = days.unionByName(_first_days(beyond, "measurement_date"))
    reached = entries.join(
        days, (F.col("subject_id") == F.col("person_id")) & (F.col("first_day") <= F.col("cohort_start_date"))
    )
    highest = reached.groupBy(*keys, "category_id").agg(F.max("grade").alias("grade"))
    return highest.groupBy(*keys).agg(F.sum("grade").cast("long").alias("score"))
