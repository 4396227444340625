"""Kaplan-Meier curves, follow-up distribution and median time at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions.mathx import ratio
from twinarm.operators.population import MODEL

ARM = [*MODEL, "treatment"]


def kaplan_meier(population: DataFrame) -> DataFrame:
    """Survival per model, arm and day with an event.

    Subjects shrink to one row per arm and day first; the windows run over days only. Those
    censored on the day of an event are still at risk.
    """
    event = F.col("outcome_count") > 0
    days = population.groupBy(*ARM, F.col("survival_time").alias("day")).agg(
        F.count("*").alias("leaving"), F.sum(F.when(event, 1).otherwise(0)).alias("events")
    )
    later = Window.partitionBy(*ARM).orderBy(F.col("day").desc())
    earlier = Window.partitionBy(*ARM).orderBy("day")
    at_risk = days.withColumn("at_risk", F.sum("leaving").over(later)).filter("events > 0")
    return at_risk.withColumn(
        "survival", F.product(1.0 - F.col("events") / F.col("at_risk")).over(earlier)
    ).select(*ARM, "day", "at_risk", "events", "survival")


def followup(population: DataFrame) -> DataFrame:
    """Share of each arm still followed up on each day somebody leaves."""
    days = population.groupBy(*ARM, F.col("time_at_risk").alias("day")).agg(
        F.count("*").alias("subjects")
    )
    later = Window.partitionBy(*ARM).orderBy(F.col("day").desc())
    whole = Window.partitionBy(*ARM)
    return days.withColumn(
        "share_followed",
        ratio(F.sum("subjects").over(later), F.sum("subjects").over(whole)),
    )


def median_time_at_risk(population: DataFrame) -> DataFrame:
    """Median days at risk of both arms, one row per model."""
    treated = F.col("treatment") == 1
    return population.groupBy(*MODEL).agg(
        F.median(F.when(treated, F.col("time_at_risk"))).alias("t_median_days"),
        F.median(F.when(~treated, F.col("time_at_risk"))).alias("c_median_days"),
    )
