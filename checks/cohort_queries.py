"""Cohort-construction queries."""

from pyspark.sql import functions as F

from checks import design
from checks.registry import VIEWS, query
from twinarm.operators import cohorts as C
from twinarm.operators.criteria import Correlated, Criterion, Group, filter_group
from twinarm.operators.events import domain_events, number_events, primary_events

EVENT_SQL = """SELECT e.person_id, {id} AS event_id, {start} AS start_date, {end} AS end_date,
       {concept} AS target_concept_id, k.codeset_id
    FROM {table} e JOIN codesets k ON k.concept_id = {concept} AND k.codeset_id IN ({sets})"""


def events(study, domain, sets=None, **options):
    return domain_events(study.cdm, design.codesets(study), domain, sets, **options)


@query(
    "c1a_drug_era",
    EVENT_SQL.format(
        id="drug_era_id", start="drug_era_start_date", end="drug_era_end_date",
        concept="drug_concept_id", table="drug_era", sets="28, 36",
    ),
)
def drug_eras(study):
    return events(study, "drug_era", [28, 36])


@query(
    "c1b_procedure",
    EVENT_SQL.format(
        id="procedure_occurrence_id", start="procedure_date", end="procedure_date + 1",
        concept="procedure_concept_id", table="procedure_occurrence", sets="20, 35",
    ),
)
def procedures(study):
    return events(study, "procedure_occurrence", [20, 35])


@query(
    "c1c_condition",
    EVENT_SQL.format(
        id="condition_occurrence_id", start="condition_start_date",
        end="coalesce(condition_end_date, condition_start_date + 1)",
        concept="condition_concept_id", table="condition_occurrence", sets="0, 4",
    ),
)
def conditions(study):
    return events(study, "condition_occurrence", [0, 4])


@query(
    "c1d_condition_era",
    EVENT_SQL.format(
        id="condition_era_id", start="condition_era_start_date", end="condition_era_end_date",
        concept="condition_concept_id", table="condition_era", sets="29, 32",
    ),
)
def condition_eras(study):
    return events(study, "condition_era", [29, 32])


@query(
    "c1e_death",
    """SELECT person_id, person_id AS event_id, death_date AS start_date,
              death_date + 1 AS end_date, CAST(coalesce(cause_concept_id, 0) AS BIGINT)
              AS target_concept_id FROM death""",
)
def deaths(study):
    return events(study, "death").drop("codeset_id")


VIEWS["first_procedure"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codeset_id, person_id
                       ORDER BY procedure_date, procedure_occurrence_id) AS n
                   FROM procedures) WHERE n = 1"""


@query(
    "c2_first_ever",
    """SELECT codeset_id, person_id, procedure_occurrence_id AS event_id,
              procedure_date AS start_date, procedure_date + 1 AS end_date,
              procedure_concept_id AS target_concept_id
       FROM first_procedure WHERE codeset_id IN (20, 35)""",
)
def first_ever(study):
    return events(study, "procedure_occurrence", [20, 35], first=True)


@query(
    "c3_date_range",
    f"""SELECT codeset_id, person_id, procedure_date AS start_date FROM first_procedure
        WHERE codeset_id = 20 AND procedure_date BETWEEN {design.sql_dates()}""",
)
def date_range(study):
    return events(
        study, "procedure_occurrence", [20], first=True, date_range=design.INDEX_RANGE
    ).select("codeset_id", "person_id", "start_date")


@query(
    "c4_visit_type",
    """SELECT codeset_id, person_id, procedure_occurrence_id AS event_id FROM first_procedure
       JOIN visit_occurrence USING (visit_occurrence_id, person_id)
       WHERE codeset_id IN (20, 35) AND visit_concept_id = 9202""",
)
def visit_type(study):
    return events(
        study, "procedure_occurrence", [20, 35], first=True, visit_types=(9202,)
    ).select("codeset_id", "person_id", "event_id")


@query(
    "c5_record_type",
    """SELECT k.codeset_id, c.person_id, c.condition_occurrence_id AS event_id
       FROM condition_occurrence c JOIN codesets k
         ON k.concept_id = c.condition_concept_id AND k.codeset_id IN (0, 4)
       WHERE condition_type_concept_id IN (38000184, 38000183)""",
)
def record_type(study):
    return events(
        study, "condition_occurrence", [0, 4], record_types=design.RECORD_TYPES
    ).select("codeset_id", "person_id", "event_id")


def all_primary(study, limit="All", prior=0):
    sources = [events(study, "procedure_occurrence", [s]) for s in (20, 35)]
    return primary_events(sources, study.cdm["observation_period"], prior, 0, limit)


VIEWS["stacked_primary"] = """
    SELECT person_id, procedure_occurrence_id AS event_id, procedure_date AS start_date,
           procedure_date + 1 AS end_date, CASE codeset_id WHEN 20 THEN 0 ELSE 1 END AS source
    FROM procedures WHERE codeset_id IN (20, 35)"""
VIEWS["observed_primary"] = """
    SELECT p.*, o.op_start AS op_start_date, o.op_end AS op_end_date
    FROM stacked_primary p JOIN observation_period o ON o.person_id = p.person_id
     AND p.start_date BETWEEN o.op_start AND o.op_end"""


@query(
    "c6_union_primary",
    "SELECT source, count(*) AS events, count(DISTINCT person_id) AS persons "
    "FROM observed_primary GROUP BY source",
)
def union_primary(study):
    return all_primary(study).groupBy("source").agg(
        F.count("*").alias("events"), F.count_distinct("person_id").alias("persons")
    )


@query(
    "c7_primary_limit",
    """SELECT f.*, o.op_start AS op_start_date, o.op_end AS op_end_date
       FROM (SELECT person_id, event_id, start_date, end_date, source
             FROM (SELECT *, row_number() OVER (PARTITION BY person_id
                       ORDER BY start_date, end_date, source, event_id) AS n
                   FROM stacked_primary) WHERE n = 1) f
       JOIN observation_period o ON o.person_id = f.person_id
        AND f.start_date BETWEEN o.op_start AND o.op_end
       WHERE o.op_start + 180 <= f.start_date""",
)
def primary_limit(study):
    return all_primary(study, "First", 180)


@query("c8_observation_join", "SELECT * FROM observed_primary")
def observation_join(study):
    return all_primary(study)


@query("c9_prior_observation", "SELECT * FROM observed_primary WHERE op_start_date + 180 <= start_date")
def prior_observation(study):
    return all_primary(study, prior=180)


@query(
    "c10_event_number",
    """SELECT person_id, source, event_id, row_number() OVER (PARTITION BY person_id
           ORDER BY start_date, end_date, source, event_id) AS event_ordinal
       FROM observed_primary""",
)
def event_number(study):
    return number_events(all_primary(study)).select(
        "person_id", "source", "event_id", "event_ordinal"
    )


def filtered(study, group):
    return filter_group(all_primary(study), group, study.cdm, design.codesets(study)).select(
        "person_id", "source", "event_id", "start_date"
    )


VIEWS["exclusion_days"] = """
    SELECT d.person_id, d.condition_era_start_date AS d FROM condition_era d JOIN codesets q
      ON q.concept_id = d.condition_concept_id AND q.codeset_id = 32"""
VIEWS["dx_days"] = """
    SELECT d.person_id, d.condition_era_start_date AS d FROM condition_era d JOIN codesets q
      ON q.concept_id = d.condition_concept_id AND q.codeset_id = 29"""
COLS = "p.person_id, p.source, p.event_id, p.start_date"


@query(
    "c11_absence",
    f"""SELECT {COLS} FROM observed_primary p WHERE NOT EXISTS (SELECT 1 FROM exclusion_days x
        WHERE x.person_id = p.person_id AND x.d BETWEEN p.op_start_date AND p.start_date)""",
)
def absence(study):
    return filtered(study, Group("ALL", (design.NO_EXCLUSION_DIAGNOSIS,)))


@query(
    "c12_presence",
    f"""SELECT {COLS} FROM observed_primary p WHERE EXISTS (SELECT 1 FROM dx_days x
        WHERE x.person_id = p.person_id AND x.d BETWEEN p.op_start_date AND p.start_date - 1)""",
)
def presence(study):
    return filtered(
        study, Group("ALL", (Correlated(Criterion("condition_era", 29), -1, min_count=1),))
    )


@query(
    "c12_count_window",
    f"""SELECT {COLS} FROM observed_primary p
        JOIN dx_days x ON x.person_id = p.person_id
         AND x.d BETWEEN greatest(p.op_start_date, p.start_date - 365) AND p.start_date - 1
        GROUP BY ALL HAVING count(*) BETWEEN 2 AND 3""",
)
def count_window(study):
    return filtered(
        study,
        Group(
            "ALL",
            (
                Correlated(
                    Criterion("condition_era", 29), -1, lower_offset=-365, min_count=2, max_count=3
                ),
            ),
        ),
    )


@query(
    "c13_nested",
    f"""SELECT {COLS} FROM observed_primary p WHERE EXISTS (SELECT 1 FROM treated_drug x
        WHERE x.person_id = p.person_id AND x.codeset_id = 36
          AND x.start_date BETWEEN p.op_start_date AND p.start_date - 1)""",
)
def nested(study):
    return filtered(study, Group("ALL", design.ANY_FIRST_LINE.members[:1]))


@query(
    "c14_all_group",
    f"""SELECT {COLS} FROM observed_primary p
        WHERE NOT EXISTS (SELECT 1 FROM exclusion_days x WHERE x.person_id = p.person_id
                            AND x.d BETWEEN p.op_start_date AND p.start_date)
          AND (SELECT count(DISTINCT codeset_id) FROM treated_drug x
               WHERE x.person_id = p.person_id AND x.start_date < p.start_date) = 3""",
)
def all_group(study):
    return filtered(
        study,
        Group(
            "ALL",
            (design.NO_EXCLUSION_DIAGNOSIS, Group("ALL", design.ANY_FIRST_LINE.members)),
        ),
    )


@query(
    "c15_any_group",
    f"""SELECT {COLS} FROM observed_primary p WHERE EXISTS (SELECT 1 FROM treated_drug x
        WHERE x.person_id = p.person_id AND x.start_date < p.start_date)""",
)
def any_group(study):
    return filtered(study, design.ANY_FIRST_LINE)


@query(
    "c16_qualified_limit",
    f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY person_id
            ORDER BY start_date, end_date, source, event_id) AS n
            FROM observed_primary p WHERE NOT EXISTS (SELECT 1 FROM exclusion_days x
              WHERE x.person_id = p.person_id AND x.d BETWEEN p.op_start_date AND p.start_date)) p
        WHERE n = 1""",
)
def qualified_limit(study):
    kept = filter_group(
        all_primary(study),
        Group("ALL", (design.NO_EXCLUSION_DIAGNOSIS,)),
        study.cdm,
        design.codesets(study),
    )
    return C.limit_events(kept, "First").select("person_id", "source", "event_id", "start_date")


def rules(study, primary):
    """Rule 0: female. Rule 1: sixty or older. Rule 2: event in the first half-year."""
    who = study.cdm["person"].select("person_id", "year_of_birth", "gender_concept_id")
    facts = primary.join(who, "person_id")
    met = F.array(
        F.when(F.col("gender_concept_id") == 8532, 0),
        F.when(F.year("start_date") - F.col("year_of_birth") >= 60, 1),
        F.when(F.month("start_date") <= 6, 2),
    )
    return facts.select(
        "person_id", "source", "event_id", F.explode(F.array_compact(met)).alias("inclusion_rule_id")
    )


VIEWS["masked"] = """
    SELECT p.*, CAST((CASE WHEN gender_concept_id = 8532 THEN 1 ELSE 0 END)
         + (CASE WHEN year(p.start_date) - year_of_birth >= 60 THEN 2 ELSE 0 END)
         + (CASE WHEN month(p.start_date) <= 6 THEN 4 ELSE 0 END) AS BIGINT) AS mask
    FROM observed_primary p JOIN person USING (person_id)"""


@query(
    "c17_rule_mask",
    "SELECT person_id, source, event_id, mask AS inclusion_rule_mask FROM masked",
)
def rule_mask(study):
    primary = all_primary(study)
    return C.inclusion_mask(primary, rules(study, primary)).select(
        "person_id", "source", "event_id", "inclusion_rule_mask"
    )


#: Rules of a definition of its own: no excluding diagnosis, treated before, seen for a year.
RULES = (
    C.InclusionRule("no excluding diagnosis", Group("ALL", (design.NO_EXCLUSION_DIAGNOSIS,))),
    C.InclusionRule("treated before", design.ANY_FIRST_LINE),
    C.InclusionRule("not treated twice as hard", Group("ANY", (
        Correlated(Criterion("drug_era", 1), 0, -200, max_count=0), Correlated(Criterion("drug_era", 34), 0, -200, max_count=0)))),
)
RULED = C.CohortDefinition(
    7, (Criterion("procedure_occurrence", 20), Criterion("procedure_occurrence", 35)), 30, 0, "All", None, "All", "First", RULES)
VIEWS["ruled_primary"] = """
    SELECT q.person_id, q.procedure_date AS start_date, CASE q.codeset_id WHEN 20 THEN 0 ELSE 1 END AS source,
           q.procedure_occurrence_id AS event_id, o.op_start, o.op_end
    FROM procedures q JOIN observation_period o ON o.person_id = q.person_id
     AND q.procedure_date BETWEEN o.op_start AND o.op_end
    WHERE q.codeset_id IN (20, 35) AND o.op_start + 30 <= q.procedure_date"""
VIEWS["hard_days"] = """
    SELECT e.person_id, k.codeset_id, e.drug_era_start_date AS d FROM drug_era e
    JOIN codesets k ON k.concept_id = e.drug_concept_id AND k.codeset_id IN (1, 34)"""
VIEWS["ruled"] = """
    SELECT p.*, CAST((CASE WHEN NOT EXISTS (SELECT 1 FROM exclusion_days x WHERE x.person_id = p.person_id
               AND x.d BETWEEN p.op_start AND p.start_date) THEN 1 ELSE 0 END)
         + (CASE WHEN EXISTS (SELECT 1 FROM treated_drug t WHERE t.person_id = p.person_id AND t.start_date >= p.op_start
               AND t.start_date < p.start_date) THEN 2 ELSE 0 END)
         + (CASE WHEN (SELECT count(DISTINCT codeset_id) FROM hard_days h WHERE h.person_id = p.person_id
               AND h.d BETWEEN greatest(p.op_start, p.start_date - 200) AND p.start_date) < 2 THEN 4 ELSE 0 END) AS BIGINT) AS mask
    FROM ruled_primary p"""


@query("c17_definition_mask", "SELECT person_id, source, event_id, mask AS inclusion_rule_mask FROM ruled")
def definition_mask(study):
    """All rules of a definition as bits of one mask, decided in one pass over shared criterion days."""
    masked = C.ruled_events(study.cdm, design.codesets(study), RULED)
    return masked.select("person_id", "source", "event_id", "inclusion_rule_mask")


@query(
    "c17_ruled_cohort",
    """SELECT CAST(7 AS BIGINT) AS cohort_definition_id, person_id AS subject_id, start_date AS cohort_start_date, op_end AS cohort_end_date
       FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY start_date, source, event_id) AS n FROM ruled WHERE mask = 7)
       WHERE n = 1""",
)
def ruled_cohort(study):
    return C.cohort_from_definition(study.cdm, design.codesets(study), RULED)


@query(
    "c28_rule_attrition",
    """SELECT step, label, count(DISTINCT person_id) AS persons, count(person_id) AS events
       FROM (VALUES (0, 'qualified events', 0), (1, 'no excluding diagnosis', 1), (2, 'treated before', 3),
                    (3, 'not treated twice as hard', 7)) AS v(step, label, bits)
       LEFT JOIN ruled ON ruled.mask & bits = bits GROUP BY step, label""",
)
def rule_attrition(study):
    return C.rule_attrition(C.ruled_events(study.cdm, design.codesets(study), RULED), RULED)


@query(
    "c18_expression_limit",
    """SELECT person_id, start_date FROM (SELECT *, row_number() OVER (PARTITION BY person_id
           ORDER BY start_date, end_date, source, event_id) AS n FROM masked WHERE mask = 7)
       WHERE n = 1""",
)
def expression_limit(study):
    primary = all_primary(study)
    met = C.meets_all_rules(C.inclusion_mask(primary, rules(study, primary)), 3)
    return C.limit_events(met, "First").select("person_id", "start_date")


@query(
    "c19_end_of_observation",
    """SELECT CAST(7 AS BIGINT) AS cohort_definition_id, person_id AS subject_id,
              start_date AS cohort_start_date, op_end_date AS cohort_end_date
       FROM observed_primary""",
)
def end_of_observation(study):
    return C.build_cohort(all_primary(study), 7)


@query(
    "c20_earliest_end",
    """SELECT CAST(8 AS BIGINT) AS cohort_definition_id, p.person_id AS subject_id,
              p.start_date AS cohort_start_date, min(e.cohort_end) AS cohort_end_date
       FROM observed_primary p
       JOIN (SELECT person_id, source, event_id, start_date + 90 AS cohort_end FROM observed_primary
             UNION ALL SELECT person_id, source, event_id, op_end_date FROM observed_primary
             UNION ALL SELECT person_id, source, event_id, start_date - 1 FROM observed_primary) e
         ON e.person_id = p.person_id AND e.source = p.source AND e.event_id = p.event_id
        AND e.cohort_end >= p.start_date
       GROUP BY p.person_id, p.source, p.event_id, p.start_date""",
)
def earliest_end(study):
    primary = all_primary(study)
    ends = primary.select(
        "person_id",
        "source",
        "event_id",
        F.explode(
            F.array(
                F.date_add("start_date", 90), F.col("op_end_date"), F.date_add("start_date", -1)
            )
        ).alias("cohort_end"),
    )
    return C.build_cohort(primary, 8, ends)


@query("c21_drug_arm", "SELECT * FROM arm_c")
def drug_arm(study):
    return design.build(study, design.ARM_C)


@query("c22_procedure_arm", "SELECT * FROM arm_a")
def procedure_arm(study):
    return design.build(study, design.ARM_A)


@query("c23_procedure_arm_excl", "SELECT * FROM arm_b")
def procedure_arm_excl(study):
    return design.build(study, design.ARM_B)


@query("c24_outcome_all", "SELECT * FROM outcome_all")
def outcome_all(study):
    return design.build(study, design.OUTCOMES[0])


@query("c25_outcome_composite", "SELECT * FROM outcome_composite")
def outcome_composite(study):
    return design.build(study, design.OUTCOMES[1])


@query("c26_negative_controls", "SELECT * FROM controls")
def negative_controls(study):
    return design.control_cohorts(study)


@query(
    "c27_treatment_ids",
    """SELECT cohort_definition_id, count(*) AS entries FROM arms
       WHERE cohort_definition_id IN (1, 2, 3) GROUP BY cohort_definition_id""",
)
def treatment(study):
    wanted = C.treatment_ids(design.comparisons(study))
    return (
        design.cohorts(study)
        .join(F.broadcast(wanted), "cohort_definition_id", "left_semi")
        .groupBy("cohort_definition_id")
        .agg(F.count("*").alias("entries"))
    )


@query(
    "c28_attrition",
    f"""SELECT 0 AS step, 'first procedure' AS label, codeset_id,
               count(DISTINCT person_id) AS subjects
        FROM first_procedure WHERE codeset_id IN (20, 35) GROUP BY codeset_id
        UNION ALL SELECT 1, 'in index range', codeset_id, count(DISTINCT person_id)
        FROM first_procedure WHERE codeset_id IN (20, 35)
         AND procedure_date BETWEEN {design.sql_dates()} GROUP BY codeset_id
        UNION ALL SELECT 2, 'outpatient', codeset_id, count(DISTINCT person_id)
        FROM first_procedure JOIN visit_occurrence USING (visit_occurrence_id, person_id)
        WHERE codeset_id IN (20, 35) AND procedure_date BETWEEN {design.sql_dates()}
         AND visit_concept_id = 9202 GROUP BY codeset_id""",
)
def attrition(study):
    def step(**options):
        return events(study, "procedure_occurrence", [20, 35], first=True, **options)

    steps = [
        ("first procedure", step()),
        ("in index range", step(date_range=design.INDEX_RANGE)),
        ("outpatient", step(date_range=design.INDEX_RANGE, visit_types=(9202,))),
    ]
    return C.attrition(steps, ["codeset_id"], "person_id")
