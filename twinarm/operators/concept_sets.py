"""Concept sets over a closed concept hierarchy."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = "codeset_id int, concept_id long, is_excluded boolean, include_descendants boolean"


def concept_set_items(
    spark: SparkSession, items: Iterable[tuple[int, int, bool, bool]]
) -> DataFrame:
    """Items written down by the caller: set id, concept, excluded?, with descendants?"""
    return spark.createDataFrame(list(items), ITEM_SCHEMA)


def descendants(ids: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Descendants of the ids, valid or not; further columns of ``ids`` are kept."""
    kept = [c for c in ids.columns if c != "concept_id"]
    return ids.join(ancestor, F.col("concept_id") == F.col("ancestor_concept_id")).select(
        *kept, F.col("descendant_concept_id").alias("concept_id")
    )


def valid_only(ids: DataFrame, concept: DataFrame) -> DataFrame:
    valid = concept.filter(F.col("invalid_reason").isNull()).select("concept_id")
    return ids.join(valid, "concept_id", "left_semi").select(*ids.columns)


def resolve_concept_sets(
    items: DataFrame, concept: DataFrame, ancestor: DataFrame, check_valid: bool = True
) -> DataFrame:
    """All sets at once: ``(codeset_id, concept_id)``.

    A concept belongs to a set when an included item covers it and no excluded item does; one
    aggregate over both kinds of items decides that.
    """
    explicit = items.select("codeset_id", "is_excluded", "concept_id")
    below = descendants(
        items.filter("include_descendants").select("codeset_id", "is_excluded", "concept_id"),
        ancestor,
    )
    covered = explicit.unionByName(below)
    if check_valid:
        covered = valid_only(covered, concept)
    return (
        covered.groupBy("codeset_id", "concept_id")
        .agg(F.bool_or("is_excluded").alias("excluded"))
        .filter(~F.col("excluded"))
        .select("codeset_id", "concept_id")
    )


def resolve_one(codesets: DataFrame, codeset_id: int) -> DataFrame:
    """Concept ids of one stored set."""
    return codesets.filter(F.col("codeset_id") == codeset_id).select("concept_id")


def standard_descendants(ids: DataFrame, concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Distinct standard concepts below the ids."""
    standard = concept.filter(F.col("standard_concept") == "S").select("concept_id")
    return (
        descendants(ids.select("concept_id"), ancestor)
        .join(standard, "concept_id", "left_semi")
        .distinct()
    )
