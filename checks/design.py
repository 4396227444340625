"""The test study: concept sets, cohort definitions and comparisons on the retail tables."""

from __future__ import annotations

import datetime
from functools import reduce

from checks.registry import VIEWS, Study
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.operators.cohorts import (
    CohortDefinition,
    cohort_from_definition,
    negative_control_cohorts,
    treatment_ids,
)
from twinarm.operators.concept_sets import concept_set_items, resolve_concept_sets
from twinarm.operators.criteria import Correlated, Criterion, Group
from twinarm.session import small_side


def brands(type_index: int, first: int, last: int) -> list[int]:
    return [10000 + 100 * type_index + b for b in range(first, last + 1)]


def _items() -> list[tuple[int, int, bool, bool]]:
    included = {
        20: brands(2, 1, 5),
        35: brands(2, 6, 12),
        28: brands(4, 1, 8),
        29: [105],
        32: brands(3, 25, 25),
        36: [101],
        1: brands(6, 1, 12),
        34: brands(6, 13, 25),
        25: brands(2, 21, 23),
        282: brands(2, 24, 25),
        0: brands(3, 1, 3),
        4: brands(3, 4, 6),
        # Risk-score categories.
        501: brands(3, 7, 7),
        502: brands(3, 8, 9),
        504: brands(3, 25, 25),
        505: brands(3, 10, 10),
        506: brands(3, 11, 12),
        # History flags: three conditions and three drugs.
        601: brands(3, 8, 9),
        602: brands(5, 1, 3),
        603: brands(5, 4, 6),
        604: brands(1, 1, 6),
        605: brands(6, 1, 12),
        606: brands(6, 13, 25),
    }
    rows = [(s, c, False, True) for s, concepts in included.items() for c in concepts]
    rows += [(35, c, True, True) for c in brands(2, 11, 12)]
    # Listed without descendants, and listed but possibly invalid.
    rows += [(282, 1000000 + p, False, False) for p in range(0, 40, 3)]
    return rows


ITEMS = _items()
CONTROLS = brands(5, 11, 25)
ARM_A, ARM_B, ARM_C = 1, 2, 3
OUTCOMES = (11, 12)
COMPARISONS = ((ARM_A, ARM_C), (ARM_B, ARM_C))
INDEX_RANGE = (datetime.date(1996, 1, 1), datetime.date(2000, 12, 31))
PRIOR_DAYS = 180
RECORD_TYPES = (38000184, 38000183)

NO_EXCLUSION_DIAGNOSIS = Correlated(Criterion("condition_era", 32), 0, max_count=0)
DIAGNOSED_BEFORE = Group("ALL", (Correlated(Criterion("condition_era", 29), 0, min_count=1),))
ANY_FIRST_LINE = Group(
    "ANY",
    tuple(
        Correlated(Criterion("drug_era", s, nested=DIAGNOSED_BEFORE), -1, min_count=1)
        for s in (36, 1, 34)
    ),
)


def procedure_arm(cohort_id: int, codeset_id: int) -> CohortDefinition:
    return CohortDefinition(
        cohort_id,
        (
            Criterion(
                "procedure_occurrence",
                codeset_id,
                first=True,
                date_range=INDEX_RANGE,
                visit_types=(9202,),
            ),
        ),
        PRIOR_DAYS,
        0,
        "First",
        Group("ALL", (NO_EXCLUSION_DIAGNOSIS, ANY_FIRST_LINE)),
        "First",
        "First",
    )


DEFINITIONS = {
    ARM_A: procedure_arm(ARM_A, 20),
    ARM_B: procedure_arm(ARM_B, 35),
    ARM_C: CohortDefinition(
        ARM_C,
        (Criterion("drug_era", 28, first=True, date_range=INDEX_RANGE),),
        PRIOR_DAYS,
        0,
        "First",
        Group(
            "ALL",
            (
                Correlated(Criterion("procedure_occurrence", 20), 0, max_count=0),
                Correlated(Criterion("procedure_occurrence", 35), 0, max_count=0),
                NO_EXCLUSION_DIAGNOSIS,
                ANY_FIRST_LINE,
            ),
        ),
        "First",
        "First",
    ),
    OUTCOMES[0]: CohortDefinition(
        OUTCOMES[0],
        (Criterion("procedure_occurrence", 25), Criterion("procedure_occurrence", 282)),
    ),
    OUTCOMES[1]: CohortDefinition(
        OUTCOMES[1],
        (
            Criterion("condition_occurrence", 0, visit_types=(9201, 9203), record_types=RECORD_TYPES),
            Criterion("death"),
            Criterion("condition_occurrence", 4, visit_types=(9201, 9203), record_types=RECORD_TYPES),
        ),
    ),
}


def items(study: Study) -> DataFrame:
    return concept_set_items(study.spark, ITEMS)


def resolve(study: Study) -> DataFrame:
    return resolve_concept_sets(
        items(study), study.cdm["concept"], study.cdm["concept_ancestor"]
    )


def codesets(study: Study) -> DataFrame:
    """The stored sets, checked for broadcast once."""
    if "codesets" not in study.built:
        study.built["codesets"] = small_side(study.stage("codesets", resolve))
    return study.built["codesets"]


def build(study: Study, cohort_id: int) -> DataFrame:
    return cohort_from_definition(study.cdm, codesets(study), DEFINITIONS[cohort_id])


def cohorts(study: Study) -> DataFrame:
    """The filled cohort table the later steps read: arms and outcomes. They are one stage, so that what
    their definitions share, such as the days of a criterion, is selected and shuffled once."""
    return study.stage(
        "cohorts", lambda s: reduce(DataFrame.unionByName, [build(s, c) for c in DEFINITIONS])
    )


def arms(study: Study) -> DataFrame:
    return cohorts(study).filter(F.col("cohort_definition_id").isin(ARM_A, ARM_B, ARM_C))


def comparisons(study: Study) -> DataFrame:
    return study.spark.createDataFrame(
        list(COMPARISONS), "target_id long, comparator_id long"
    )


def control_ids(study: Study) -> DataFrame:
    return study.spark.createDataFrame([(c,) for c in CONTROLS], "concept_id long")


def control_cohorts(study: Study) -> DataFrame:
    return negative_control_cohorts(
        arms(study),
        study.cdm["condition_occurrence"],
        study.cdm["concept_ancestor"],
        treatment_ids(comparisons(study)),
        control_ids(study),
    )


def sql_dates() -> str:
    return " AND ".join(f"DATE '{d}'" for d in INDEX_RANGE)


VIEWS["comparisons"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({t} AS BIGINT), CAST({c} AS BIGINT))" for t, c in COMPARISONS)
    + ") AS v(target_id, comparator_id)"
)
VIEWS["items"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({s}, {c}, {str(x).lower()}, {str(d).lower()})" for s, c, x, d in ITEMS)
    + ") AS v(codeset_id, concept_id, is_excluded, include_descendants)"
)
VIEWS["covered"] = """
    SELECT DISTINCT i.codeset_id, i.is_excluded, c.concept_id
    FROM items i
    JOIN (SELECT ancestor_concept_id AS a, descendant_concept_id AS d, true AS below
          FROM concept_ancestor
          UNION ALL SELECT concept_id, concept_id, false FROM concept) x
      ON x.a = i.concept_id AND (NOT x.below OR i.include_descendants)
    JOIN concept c ON c.concept_id = x.d AND c.invalid_reason IS NULL"""
VIEWS["codesets"] = """
    SELECT codeset_id, concept_id FROM covered WHERE NOT is_excluded
    EXCEPT SELECT codeset_id, concept_id FROM covered WHERE is_excluded"""
VIEWS["treated_drug"] = """
    SELECT DISTINCT e.person_id, k.codeset_id, e.drug_era_start_date AS start_date
    FROM drug_era e
    JOIN codesets k ON k.concept_id = e.drug_concept_id AND k.codeset_id IN (36, 1, 34)
    JOIN observation_period o ON o.person_id = e.person_id
     AND e.drug_era_start_date BETWEEN o.op_start AND o.op_end
    WHERE EXISTS (
        SELECT 1 FROM condition_era d JOIN codesets q
          ON q.concept_id = d.condition_concept_id AND q.codeset_id = 29
        WHERE d.person_id = e.person_id
          AND d.condition_era_start_date BETWEEN o.op_start AND e.drug_era_start_date)"""
VIEWS["any_first_line"] = """
    SELECT person_id, min(start_date) AS first_date FROM treated_drug GROUP BY person_id"""
VIEWS["exclusion_dx"] = """
    SELECT d.person_id, min(d.condition_era_start_date) AS first_date
    FROM condition_era d JOIN codesets q
      ON q.concept_id = d.condition_concept_id AND q.codeset_id = 32
    GROUP BY d.person_id"""
VIEWS["procedures"] = """
    SELECT k.codeset_id, p.* FROM procedure_occurrence p
    JOIN codesets k ON k.concept_id = p.procedure_concept_id"""


def _primary_sql(codeset: int, kind: str) -> str:
    if kind == "procedure":
        inner = f"""
            SELECT person_id, procedure_date AS start_date, visit_occurrence_id,
                   row_number() OVER (PARTITION BY person_id
                       ORDER BY procedure_date, procedure_occurrence_id) AS n
            FROM procedures WHERE codeset_id = {codeset}"""
        visit = """JOIN visit_occurrence v ON v.visit_occurrence_id = f.visit_occurrence_id
            AND v.person_id = f.person_id AND v.visit_concept_id = 9202"""
    else:
        inner = f"""
            SELECT person_id, drug_era_start_date AS start_date,
                   row_number() OVER (PARTITION BY person_id
                       ORDER BY drug_era_start_date, drug_era_id) AS n
            FROM drug_era e JOIN codesets k
              ON k.concept_id = e.drug_concept_id AND k.codeset_id = {codeset}"""
        visit = ""
    return f"""
        SELECT f.person_id, f.start_date, o.op_start, o.op_end FROM ({inner}) f {visit}
        JOIN observation_period o ON o.person_id = f.person_id
         AND f.start_date BETWEEN o.op_start AND o.op_end
        WHERE n = 1 AND f.start_date BETWEEN {sql_dates()}
          AND o.op_start + {PRIOR_DAYS} <= f.start_date"""


def _arm_sql(cohort_id: int, primary: str, without_procedures: bool) -> str:
    absent = (
        """AND NOT EXISTS (SELECT 1 FROM procedures x WHERE x.codeset_id IN (20, 35)
               AND x.person_id = p.person_id AND x.procedure_date <= p.start_date)"""
        if without_procedures
        else ""
    )
    return f"""
        SELECT CAST({cohort_id} AS BIGINT) AS cohort_definition_id, p.person_id AS subject_id,
               p.start_date AS cohort_start_date, p.op_end AS cohort_end_date
        FROM ({primary}) p
        LEFT JOIN exclusion_dx x ON x.person_id = p.person_id AND x.first_date <= p.start_date
        JOIN any_first_line a ON a.person_id = p.person_id AND a.first_date < p.start_date
        WHERE x.person_id IS NULL {absent}"""


VIEWS["primary_a"] = _primary_sql(20, "procedure")
VIEWS["primary_c"] = _primary_sql(28, "drug")
VIEWS["arm_a"] = _arm_sql(ARM_A, "SELECT * FROM primary_a", False)
VIEWS["arm_b"] = _arm_sql(ARM_B, _primary_sql(35, "procedure"), False)
VIEWS["arm_c"] = _arm_sql(ARM_C, "SELECT * FROM primary_c", True)
VIEWS["outcome_all"] = f"""
    SELECT CAST({OUTCOMES[0]} AS BIGINT) AS cohort_definition_id, p.person_id AS subject_id,
           p.procedure_date AS cohort_start_date, o.op_end AS cohort_end_date
    FROM procedures p JOIN observation_period o ON o.person_id = p.person_id
     AND p.procedure_date BETWEEN o.op_start AND o.op_end
    WHERE p.codeset_id IN (25, 282)"""
VIEWS["outcome_composite"] = f"""
    SELECT CAST({OUTCOMES[1]} AS BIGINT) AS cohort_definition_id, e.person_id AS subject_id,
           e.d AS cohort_start_date, o.op_end AS cohort_end_date
    FROM (SELECT c.person_id, c.condition_start_date AS d
          FROM condition_occurrence c
          JOIN codesets k ON k.concept_id = c.condition_concept_id AND k.codeset_id IN (0, 4)
          JOIN visit_occurrence v USING (visit_occurrence_id, person_id)
          WHERE v.visit_concept_id IN (9201, 9203)
            AND c.condition_type_concept_id IN (38000184, 38000183)
          UNION ALL SELECT person_id, death_date FROM death) e
    JOIN observation_period o ON o.person_id = e.person_id AND e.d BETWEEN o.op_start AND o.op_end"""
VIEWS["arms"] = "SELECT * FROM arm_a UNION ALL SELECT * FROM arm_b UNION ALL SELECT * FROM arm_c"
VIEWS["outcomes"] = "SELECT * FROM outcome_all UNION ALL SELECT * FROM outcome_composite"
VIEWS["controls"] = f"""
    SELECT CAST(x.ancestor_concept_id AS BIGINT) AS cohort_definition_id, a.subject_id,
           c.condition_start_date AS cohort_start_date,
           coalesce(c.condition_end_date, c.condition_start_date + 1) AS cohort_end_date
    FROM arms a JOIN condition_occurrence c ON c.person_id = a.subject_id
     AND c.condition_start_date >= a.cohort_start_date
    JOIN concept_ancestor x ON x.descendant_concept_id = c.condition_concept_id
    WHERE x.ancestor_concept_id IN ({", ".join(map(str, CONTROLS))})"""
