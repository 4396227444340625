"""Records that can matter to a cohort, picked before anything is grouped or multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.session import small_side


def near_index(
    cohort: DataFrame,
    table: DataFrame,
    start: str,
    before: int | None = None,
    after: int | None = 0,
) -> DataFrame:
    """Records of cohort persons from ``before`` days before their first index to ``after`` days
    behind their last; None sets no bound. The spans of the cohort are broadcast where their checked
    number allows it."""
    index = F.col("cohort_start_date")
    spans = cohort.groupBy(F.col("subject_id").alias("person_id")).agg(
        F.min(index).alias("__first"), F.max(index).alias("__last")
    )
    met = table.join(small_side(spans), "person_id")
    if before is not None:
        met = met.filter(F.col(start) >= F.date_sub("__first", before))
    if after is not None:
        met = met.filter(F.col(start) <= F.date_add("__last", after))
    return met.drop("__first", "__last")
