"""What is shuffled, and how often, once tables are too large to be broadcast."""

import pytest
from pyspark.sql import functions as F

from checks import design, study_queries
from checks.adapter import retail_cdm
from checks.registry import Study
from twinarm.operators import events, families, matching
from twinarm.sources.cdm import Cdm

SF = "/root/testdata/sf0.001"


def shuffles(df, key):
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({key}")


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_records_are_picked_before_they_meet_their_visits(frame):
    tables = {
        "condition_occurrence": frame(
            [(1, 7, "2000-01-01", 100), (1, 8, "2000-01-01", 101), (2, 7, "2000-01-01", 102), (1, 9, "2000-01-01", None)],
            "person_id long, condition_concept_id long, condition_start_date date, visit_occurrence_id long",
        ),
        # A visit listed twice, one of another type, one of another person.
        "visit_occurrence": frame(
            [(100, 1, 9201), (100, 1, 9201), (101, 1, 9202), (102, 2, 9201), (101, 2, 9201)],
            "visit_occurrence_id long, person_id long, visit_concept_id int",
        ),
    }
    cohort = frame([(1, 1, "2000-01-10")], "cohort_definition_id long, subject_id long, cohort_start_date date")
    rows = families.inpatient_conditions(cohort, Cdm(tables.__getitem__))
    assert [(r.covariate_id, r.covariate_value) for r in rows.collect()] == [(7103, 1.0)]
    assert "LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_picked_before_they_meet_their_visits(frame):
    tables = {
        "condition_occurrence": frame(
            [(i, 1, 7, "2000-01-01", None, 5, 100 + i) for i in range(3)],
            "condition_occurrence_id long, person_id long, condition_concept_id long, condition_start_date date, "
            "condition_end_date date, condition_type_concept_id int, visit_occurrence_id long",
        ),
        "visit_occurrence": frame(
            [(100, 1, 9201), (100, 1, 9203), (101, 1, 9202)],
            "visit_occurrence_id long, person_id long, visit_concept_id int",
        ),
    }
    codesets = frame([(4, 7)], "codeset_id int, concept_id long")
    found = events.domain_events(
        Cdm(tables.__getitem__), codesets, "condition_occurrence", [4], visit_types=(9201, 9203)
    )
    assert [r.event_id for r in found.collect()] == [0]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_eras_are_dealt_once(spark):
    for domain in ("drug_era", "condition_era"):
        assert shuffles(retail_cdm(spark, SF)[domain], "person_id") == 1


def test_stored_records_hold_no_derived_ids(spark):
    kept = {}

    def stage(name, build, by):
        kept[name] = build()
        return kept[name]

    known = retail_cdm(spark, SF, stage)["procedure_occurrence"]
    assert not {"occ_id", "concept_id", "visit_occurrence_id"} & set(kept["records"].columns)
    assert known.filter("procedure_occurrence_id is null or procedure_concept_id is null").count() == 0


def test_cohorts_are_one_stage(spark):
    names = []

    class Listed(Study):
        def stage(self, name, build):
            names.append(name)
            return super().stage(name, build)

    found = design.cohorts(Listed(spark, SF))
    assert [n for n in names if n.startswith("cohort")] == ["cohorts"]
    ids = {r[0] for r in found.select("cohort_definition_id").distinct().collect()}
    assert ids <= set(design.DEFINITIONS) and len(ids) > 1


def test_rows_stay_in_place_for_a_value_of_each_model(without_broadcasts, frame):
    rows = frame(
        [(1, 3, 11, i % 2, i, "2000-01-01", i / 10) for i in range(8)],
        "target_id long, comparator_id long, outcome_id long, treatment int, subject_id long, "
        "cohort_start_date date, ps double",
    )
    assert shuffles(matching._scored(rows, study_queries.MODEL, 0.2, "standardized"), "target_id") == 1
    scored = study_queries.cell_scores(Study(without_broadcasts, SF), rows.drop("ps"))
    assert shuffles(scored, "target_id") == 1


def test_a_union_does_not_count_as_partitioned(without_broadcasts):
    one = without_broadcasts.range(100).select((F.col("id") % 7).alias("k"))
    both = one.repartition(4, "k").unionByName(one.repartition(4, "k")).groupBy("k").count()
    assert shuffles(both, "k") == 3
    assert both.agg(F.sum("count")).first()[0] == 200
