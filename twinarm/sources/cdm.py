"""Readers for patient-event tables, concept lists and cohort definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns each table must offer, in Spark DDL.
TABLE_SCHEMAS = {
    "concept": "concept_id long, invalid_reason string, standard_concept string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long",
    "person": "person_id long, year_of_birth int, gender_concept_id int, race_concept_id int, "
    "ethnicity_concept_id int",
    "observation_period": "person_id long, observation_period_start_date date, "
    "observation_period_end_date date",
    "visit_occurrence": "visit_occurrence_id long, person_id long, visit_concept_id int",
    "condition_occurrence": "condition_occurrence_id long, person_id long, "
    "condition_concept_id long, condition_start_date date, condition_end_date date, "
    "condition_type_concept_id int, visit_occurrence_id long",
    "procedure_occurrence": "procedure_occurrence_id long, person_id long, "
    "procedure_concept_id long, procedure_date date, visit_occurrence_id long",
    "drug_exposure": "person_id long, drug_concept_id long, drug_exposure_start_date date",
    "device_exposure": "person_id long, device_concept_id long, device_exposure_start_date date",
    "measurement": "person_id long, measurement_concept_id long, measurement_date date, "
    "value_as_number double, range_low double, range_high double",
    "observation": "person_id long, observation_concept_id long, observation_date date",
    "specimen": "person_id long, specimen_concept_id long, specimen_date date",
    "condition_era": "condition_era_id long, person_id long, condition_concept_id long, "
    "condition_era_start_date date, condition_era_end_date date",
    "drug_era": "drug_era_id long, person_id long, drug_concept_id long, "
    "drug_era_start_date date, drug_era_end_date date",
    "death": "person_id long, death_date date, cause_concept_id long",
    "cohort": "cohort_definition_id long, subject_id long, cohort_start_date date, "
    "cohort_end_date date",
}

DEFINITION_SCHEMA = """
    ConceptSets array<struct<id: int, name: string, expression: struct<items: array<struct<
        concept: struct<CONCEPT_ID: long, CONCEPT_NAME: string, DOMAIN_ID: string,
                        VOCABULARY_ID: string, STANDARD_CONCEPT: string, INVALID_REASON: string>,
        isExcluded: boolean, includeDescendants: boolean>>>>>,
    PrimaryCriteria struct<
        CriteriaList: array<map<string, struct<CodesetId: int, First: boolean,
            OccurrenceStartDate: struct<Value: string, Extent: string, Op: string>,
            VisitType: array<struct<CONCEPT_ID: long>>,
            ConditionType: array<struct<CONCEPT_ID: long>>>>>,
        ObservationWindow: struct<PriorDays: string, PostDays: string>,
        PrimaryCriteriaLimit: struct<Type: string>>,
    QualifiedLimit struct<Type: string>,
    ExpressionLimit struct<Type: string>
"""


class Cdm:
    """Named tables, each built on first use."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._tables:
            self._tables[table] = self._load(table)
        return self._tables[table]


def read_cdm(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of a parquet store, or of the catalog when ``root`` is ``catalog:<schema>``."""
    source = (
        spark.table(f"{root.removeprefix('catalog:')}.{table}")
        if root.startswith("catalog:")
        else spark.read.parquet(f"{root.rstrip('/')}/{table}")
    )
    columns = [part.split() for part in TABLE_SCHEMAS[table].split(", ")]
    return source.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def open_cdm(spark: SparkSession, root: str) -> Cdm:
    return Cdm(lambda table: read_cdm(spark, root, table))


def read_concept_lists(spark: SparkSession, folder: str) -> DataFrame:
    """All one-column concept lists of a folder, duplicates kept."""
    return (
        spark.read.schema("CONCEPT_ID long")
        .csv(folder, header=True)
        .select(F.col("CONCEPT_ID").alias("concept_id"))
    )


def read_cohort_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Cohort-definition JSON files, one row per file."""
    return (
        spark.read.schema(DEFINITION_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .withColumn("source_file", F.input_file_name())
    )


def definition_items(definitions: DataFrame) -> DataFrame:
    """Concept-set items of the definitions; a flag that is absent counts as false."""
    sets = definitions.select("source_file", F.explode("ConceptSets").alias("s"))
    items = sets.select(
        "source_file",
        F.col("s.id").alias("codeset_id"),
        F.col("s.name").alias("codeset_name"),
        F.explode("s.expression.items").alias("i"),
    )
    return items.select(
        "source_file",
        "codeset_id",
        "codeset_name",
        F.col("i.concept.CONCEPT_ID").alias("concept_id"),
        F.coalesce("i.isExcluded", F.lit(False)).alias("is_excluded"),
        F.coalesce("i.includeDescendants", F.lit(False)).alias("include_descendants"),
    )


def definition_criteria(definitions: DataFrame) -> DataFrame:
    """Primary criteria of the definitions with their observation window and limits."""
    listed = definitions.select(
        "source_file",
        F.posexplode("PrimaryCriteria.CriteriaList").alias("position", "criterion"),
        F.col("PrimaryCriteria.ObservationWindow.PriorDays").cast("int").alias("prior_days"),
        F.col("PrimaryCriteria.ObservationWindow.PostDays").cast("int").alias("post_days"),
        F.col("PrimaryCriteria.PrimaryCriteriaLimit.Type").alias("primary_limit"),
        F.col("QualifiedLimit.Type").alias("qualified_limit"),
        F.col("ExpressionLimit.Type").alias("expression_limit"),
    )
    opened = listed.select("*", F.explode("criterion").alias("domain", "c")).drop("criterion")
    return opened.select(
        "source_file",
        "position",
        "domain",
        F.col("c.CodesetId").alias("codeset_id"),
        F.coalesce("c.First", F.lit(False)).alias("first_only"),
        F.col("c.OccurrenceStartDate.Value").cast("date").alias("range_start"),
        F.col("c.OccurrenceStartDate.Extent").cast("date").alias("range_end"),
        F.col("c.VisitType.CONCEPT_ID").alias("visit_types"),
        F.col("c.ConditionType.CONCEPT_ID").alias("record_types"),
        "prior_days",
        "post_days",
        "primary_limit",
        "qualified_limit",
        "expression_limit",
    )
