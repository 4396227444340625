"""Age and age bands at index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_band(age: Column) -> Column:
    """Five-year band label; anything outside 0-99, unknown ages too, is ``100+``."""
    low = (F.floor(age / 5) * 5).cast("int")
    return F.when(
        age.between(0, 99),
        F.concat(F.lit("Age Group "), low.cast("string"), F.lit("-"), (low + 4).cast("string")),
    ).otherwise(F.lit("Age Group 100+"))


def age_groups(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Age and age band of each distinct cohort entry."""
    births = person.select(F.col("person_id").alias("subject_id"), "year_of_birth")
    age = (F.year("cohort_start_date") - F.col("year_of_birth")).alias("age_at_index")
    return (
        cohort.select("cohort_definition_id", "subject_id", "cohort_start_date")
        .distinct()
        .join(births, "subject_id")
        .select("cohort_definition_id", "subject_id", age)
        .withColumn("age_group", age_band(F.col("age_at_index")))
    )
