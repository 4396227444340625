"""Queries on covariates at index."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import design
from checks.registry import VIEWS, query
from twinarm.operators import families as X
from twinarm.operators import history as H
from twinarm.operators import scores as S
from twinarm.operators.demographics import age_groups

CATEGORY_OF = {501: 1, 502: 2, 504: 4, 505: 5, 506: 6}
HISTORY = {601: "condition", 602: "condition", 603: "condition"}
HISTORY |= {604: "drug", 605: "drug", 606: "drug"}
CHARLSON_WEIGHTS = {1: 1, 2: 2, 4: 3, 5: 6}


def entries(study):
    return design.arms(study)


VIEWS["ages"] = """
    SELECT DISTINCT a.cohort_definition_id, a.subject_id, a.cohort_start_date,
           CAST(year(a.cohort_start_date) AS INTEGER) - p.year_of_birth AS age_at_index,
           p.gender_concept_id
    FROM arms a JOIN person p ON p.person_id = a.subject_id"""
VIEWS["age_bands"] = """
    SELECT cohort_definition_id, subject_id, age_at_index,
           CASE WHEN age_at_index BETWEEN 0 AND 99
                THEN 'Age Group ' || (age_at_index // 5 * 5) || '-' || (age_at_index // 5 * 5 + 4)
                ELSE 'Age Group 100+' END AS age_group
    FROM ages"""


@query("f1_age_at_index", "SELECT cohort_definition_id, subject_id, age_at_index FROM ages")
def ages(study):
    return age_groups(entries(study), study.cdm["person"]).drop("age_group")


@query("f2_age_groups", "SELECT * FROM age_bands")
def bands(study):
    return age_groups(entries(study), study.cdm["person"])


def categories(study, weights, numbers=(1, 2, 4, 5)):
    chosen = {s: c for s, c in CATEGORY_OF.items() if c in numbers}
    return S.score_categories(design.codesets(study), chosen, weights)


def chads2(study):
    return S.weighted_score(
        entries(study),
        study.cdm["condition_era"],
        study.cdm["person"],
        categories(study, S.CHADS2_WEIGHTS),
        S.CHADS2_DEMOGRAPHICS,
        keep_any_history=True,
    )


def chads2vasc(study):
    return S.weighted_score(
        entries(study),
        study.cdm["condition_era"],
        study.cdm["person"],
        categories(study, S.CHADS2VASC_WEIGHTS, (1, 2, 4, 5, 6)),
        S.CHADS2VASC_DEMOGRAPHICS,
    )


#: Grades of the complication score by concept set, and the values of measurements that count as evidence.
GRADES = {501: (1, 1), 502: (1, 2), 504: (2, 1), 505: (2, 2), 506: (3, 1)}
LIMITS = ((2, 1, 2, None, 95.0), (3, 2, 3, None, 120.0), (3, 1, 1, 2.0, 150.0), (4, 1, 4, 1.0, None))


def complications(study):
    spark = study.spark
    graded = spark.createDataFrame([(s, *g) for s, g in GRADES.items()], "codeset_id int, category_id int, grade int")
    limits = spark.createDataFrame(LIMITS, "category_id int, grade int, concept_id long, low double, high double")
    grades = design.codesets(study).join(F.broadcast(graded), "codeset_id").select("category_id", "grade", "concept_id")
    return S.graded_score(
        entries(study), study.cdm["condition_era"], grades, study.cdm["measurement"], limits
    )


def charlson_like(study):
    return S.weighted_score(
        entries(study),
        study.cdm["condition_era"],
        study.cdm["person"],
        categories(study, CHARLSON_WEIGHTS),
        include_zero=True,
    )


VIEWS["scored_eras"] = """
    SELECT DISTINCT a.cohort_definition_id, a.subject_id,
           CASE k.codeset_id WHEN 501 THEN 1 WHEN 502 THEN 2 WHEN 504 THEN 4 WHEN 505 THEN 5
                             WHEN 506 THEN 6 END AS category
    FROM arms a JOIN condition_era e ON e.person_id = a.subject_id
     AND e.condition_era_start_date <= a.cohort_start_date
    LEFT JOIN codesets k ON k.concept_id = e.condition_concept_id
     AND k.codeset_id IN (501, 502, 504, 505, 506)"""
VIEWS["chads2"] = """
    SELECT cohort_definition_id, subject_id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS score
    FROM (SELECT DISTINCT cohort_definition_id, subject_id, CASE WHEN category < 6 THEN category END
                 AS category,
                 CASE category WHEN 5 THEN 2 WHEN 6 THEN NULL ELSE category - category + 1 END
                 AS weight
          FROM scored_eras
          UNION SELECT cohort_definition_id, subject_id, 3, 1 FROM ages WHERE age_at_index >= 75)
    GROUP BY cohort_definition_id, subject_id"""
VIEWS["chads2vasc"] = """
    SELECT cohort_definition_id, subject_id, CAST(sum(weight) AS BIGINT) AS score
    FROM (SELECT cohort_definition_id, subject_id, category,
                 CASE category WHEN 5 THEN 2 ELSE 1 END AS weight
          FROM scored_eras WHERE category IS NOT NULL
          UNION SELECT cohort_definition_id, subject_id, 3, 2 FROM ages WHERE age_at_index >= 75
          UNION SELECT cohort_definition_id, subject_id, 7, 1 FROM ages
                WHERE age_at_index BETWEEN 65 AND 74
          UNION SELECT cohort_definition_id, subject_id, 8, 1 FROM ages
                WHERE gender_concept_id = 8532)
    GROUP BY cohort_definition_id, subject_id"""
VIEWS["charlson"] = """
    SELECT a.cohort_definition_id, a.subject_id, CAST(coalesce(sum(CASE category WHEN 1 THEN 1
           WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 6 END), 0) AS BIGINT) AS score
    FROM (SELECT DISTINCT cohort_definition_id, subject_id FROM arms) a
    LEFT JOIN scored_eras USING (cohort_definition_id, subject_id)
    GROUP BY a.cohort_definition_id, a.subject_id"""


VIEWS["complications"] = f"""
    WITH evidence AS (
      SELECT a.cohort_definition_id, a.subject_id, g.category, g.grade
      FROM arms a JOIN condition_era e ON e.person_id = a.subject_id AND e.condition_era_start_date <= a.cohort_start_date
      JOIN codesets k ON k.concept_id = e.condition_concept_id
      JOIN (VALUES {", ".join(f"({s}, {c}, {g})" for s, (c, g) in GRADES.items())}) g(codeset, category, grade) ON g.codeset = k.codeset_id
      UNION ALL
      SELECT a.cohort_definition_id, a.subject_id, l.category, l.grade
      FROM arms a JOIN measurement m ON m.person_id = a.subject_id AND m.measurement_date <= a.cohort_start_date
      JOIN (VALUES {", ".join(f"({c}, {g}, {k}, {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)"
                              for c, g, k, lo, hi in LIMITS)}) l(category, grade, concept, low, high)
        ON l.concept = m.measurement_concept_id AND (m.value_as_number < l.low OR m.value_as_number > l.high))
    SELECT cohort_definition_id, subject_id, CAST(sum(grade) AS BIGINT) AS score
    FROM (SELECT cohort_definition_id, subject_id, category, max(grade) AS grade FROM evidence GROUP BY ALL) GROUP BY ALL"""


@query("f3_chads2", "SELECT * FROM chads2")
def chads2_query(study):
    return chads2(study)


@query("f4_chads2vasc", "SELECT * FROM chads2vasc")
def chads2vasc_query(study):
    return chads2vasc(study)


@query("f5_weighted_score", "SELECT * FROM charlson")
def weighted_query(study):
    return charlson_like(study)


@query("f5_graded_score", "SELECT * FROM complications")
def graded_query(study):
    return complications(study)


def first_diagnosis(study):
    dated = H.domain_records(study.cdm, ["condition"])
    wanted = design.codesets(study).filter("codeset_id = 29")
    return H.first_dates(dated, wanted).select("person_id", "first_date")


def days_with_diagnosis(study):
    return H.days_since_first(entries(study), first_diagnosis(study))


VIEWS["dx_history"] = """
    SELECT a.cohort_definition_id, a.subject_id,
           CAST(min(date_diff('day', d.first_date, a.cohort_start_date)) AS BIGINT) AS score
    FROM arms a JOIN (SELECT c.person_id, min(c.condition_start_date) AS first_date
                      FROM condition_occurrence c JOIN codesets k
                        ON k.concept_id = c.condition_concept_id AND k.codeset_id = 29
                      GROUP BY c.person_id) d
      ON d.person_id = a.subject_id AND d.first_date < a.cohort_start_date
    GROUP BY a.cohort_definition_id, a.subject_id"""


@query("f6_days_since_dx", "SELECT * FROM dx_history")
def days_query(study):
    return days_with_diagnosis(study)


@query(
    "f6_days_summary",
    """SELECT cohort_definition_id, count(*) AS subjects, median(score) AS median_days,
              min(score) AS min_days, max(score) AS max_days
       FROM dx_history GROUP BY cohort_definition_id""",
)
def days_summary(study):
    return days_with_diagnosis(study).groupBy("cohort_definition_id").agg(
        F.count("*").alias("subjects"),
        F.median("score").alias("median_days"),
        F.min("score").alias("min_days"),
        F.max("score").alias("max_days"),
    )


def history_sets(study):
    """Concept sets of the history flags with the domain each one is looked up in."""
    domain = F.when(F.col("codeset_id") <= 603, "condition").otherwise("drug")
    return design.codesets(study).filter(F.col("codeset_id").isin(*HISTORY)).withColumn(
        "domain", domain
    )


def history_flags(study, comparisons, keys):
    firsts = H.first_dates(
        H.domain_records(study.cdm, ["condition", "drug"]), history_sets(study)
    )
    rows = H.arm_rows(entries(study), comparisons).withColumn(
        "codeset_id", F.explode(F.array(*[F.lit(s) for s in HISTORY]))
    )
    return H.history_flag(rows, firsts, keys)


VIEWS["records"] = """
    SELECT person_id, 'condition' AS domain, condition_concept_id AS concept_id,
           condition_start_date AS start_date FROM condition_occurrence
    UNION ALL SELECT person_id, 'drug', drug_concept_id, drug_exposure_start_date
              FROM drug_exposure
    UNION ALL SELECT person_id, 'procedure', procedure_concept_id, procedure_date
              FROM procedure_occurrence
    UNION ALL SELECT person_id, 'device', device_concept_id, device_exposure_start_date
              FROM device_exposure
    UNION ALL SELECT person_id, 'measurement', measurement_concept_id, measurement_date
              FROM measurement
    UNION ALL SELECT person_id, 'observation', observation_concept_id, observation_date
              FROM observation
    UNION ALL SELECT person_id, 'specimen', specimen_concept_id, specimen_date FROM specimen"""
VIEWS["pairs_of_arms"] = """
    SELECT c.target_id, c.comparator_id, a.cohort_definition_id,
           CASE WHEN a.cohort_definition_id = c.target_id THEN 1 ELSE 0 END AS treatment,
           a.subject_id, a.cohort_start_date, a.cohort_end_date
    FROM (VALUES (CAST(1 AS BIGINT), CAST(3 AS BIGINT)), (2, 3)) c(target_id, comparator_id)
    JOIN arms a ON a.cohort_definition_id IN (c.target_id, c.comparator_id)"""
VIEWS["flags"] = """
    SELECT DISTINCT p.target_id, p.comparator_id, p.treatment, s.codeset_id, p.subject_id,
           CASE WHEN EXISTS (
               SELECT 1 FROM records r JOIN codesets k
                 ON k.concept_id = r.concept_id AND k.codeset_id = s.codeset_id
               WHERE r.person_id = p.subject_id AND r.start_date < p.cohort_start_date
                 AND r.domain = CASE WHEN s.codeset_id <= 603 THEN 'condition' ELSE 'drug' END)
           THEN 1 ELSE 0 END AS score
    FROM pairs_of_arms p, (VALUES (601), (602), (603), (604), (605), (606)) s(codeset_id)"""


@query("f7_history_flag", "SELECT * FROM flags")
def flags_query(study):
    return history_flags(
        study, design.comparisons(study), ["target_id", "comparator_id", "treatment"]
    )


@query(
    "f9_treatment_flag",
    """SELECT target_id, comparator_id, treatment, subject_id, cohort_start_date
       FROM pairs_of_arms""",
)
def treatment_flag(study):
    return H.arm_rows(entries(study), design.comparisons(study)).select(
        "target_id", "comparator_id", "treatment", "subject_id", "cohort_start_date"
    )


@query(
    "f11_domain_records",
    """SELECT domain, concept_id, count(*) AS records, min(start_date) AS first_date
       FROM records GROUP BY domain, concept_id""",
)
def domain_records(study):
    return H.domain_records(study.cdm).groupBy("domain", "concept_id").agg(
        F.count("*").alias("records"), F.min("start_date").alias("first_date")
    )


# --- covariate families --------------------------------------------------------------------------

ENTRY = "cohort_definition_id, subject_id, cohort_start_date"
A = X.ANALYSIS


def flag_sql(table, concept, start, windows):
    """Presence in closed windows before index, one branch per (analysis, days)."""
    return " UNION ALL ".join(
        f"""SELECT DISTINCT {ENTRY}, {concept} * 1000 + {A[name]} AS covariate_id,
                   CAST(1 AS DOUBLE) AS covariate_value
            FROM arms JOIN {table} t ON t.person_id = subject_id
             AND t.{start} BETWEEN cohort_start_date - {days} AND cohort_start_date"""
        for name, days in windows.items()
    )


def count_sql(table, concept, start, name, days):
    return f"""SELECT {ENTRY}, {concept} * 1000 + {A[name]} AS covariate_id,
               CAST(count(*) AS DOUBLE) AS covariate_value
        FROM (SELECT DISTINCT {ENTRY} FROM arms) a JOIN {table} t ON t.person_id = subject_id
         AND t.{start} BETWEEN cohort_start_date - {days} AND cohort_start_date
        GROUP BY ALL"""


def era_sql(domain, tests):
    return " UNION ALL ".join(
        f"""SELECT DISTINCT {ENTRY}, {domain}_concept_id * 1000 + {A[name]} AS covariate_id,
                   CAST(1 AS DOUBLE) AS covariate_value
            FROM arms JOIN {domain}_era t ON t.person_id = subject_id
             AND {domain}_era_start_date <= cohort_start_date AND {test}"""
        for name, test in tests.items()
    )


VIEWS["x_demographics"] = f"""
    WITH who AS (SELECT DISTINCT {ENTRY}, p.* FROM arms JOIN person p ON p.person_id = subject_id)
    SELECT {ENTRY}, CAST(v * 1000 + analysis AS BIGINT) AS covariate_id,
           CAST(1 AS DOUBLE) AS covariate_value
    FROM (SELECT {ENTRY}, gender_concept_id AS v, {A["gender"]} AS analysis FROM who
          UNION ALL SELECT {ENTRY}, race_concept_id, {A["race"]} FROM who
          UNION ALL SELECT {ENTRY}, ethnicity_concept_id, {A["ethnicity"]} FROM who
          UNION ALL SELECT {ENTRY}, (year(cohort_start_date) - year_of_birth) // 5,
                           {A["age_band"]} FROM who
          UNION ALL SELECT {ENTRY}, year(cohort_start_date), {A["index_year"]} FROM who
          UNION ALL SELECT {ENTRY}, month(cohort_start_date), {A["index_month"]} FROM who)"""
VIEWS["x_conditions"] = flag_sql(
    "condition_occurrence", "condition_concept_id", "condition_start_date",
    {"condition_long": 180, "condition_short": 30},
)
VIEWS["x_inpatient"] = flag_sql(
    """(SELECT c.* FROM condition_occurrence c JOIN visit_occurrence v
        USING (visit_occurrence_id, person_id) WHERE visit_concept_id = 9201)""",
    "condition_concept_id", "condition_start_date", {"condition_inpatient_medium": 120},
)
VIEWS["x_condition_eras"] = era_sql(
    "condition",
    {
        "condition_era_ever": "true",
        "condition_era_overlap": "condition_era_end_date >= cohort_start_date",
    },
)
VIEWS["x_groups"] = flag_sql(
    """(SELECT c.person_id, c.condition_start_date, x.ancestor_concept_id
        FROM condition_occurrence c
        JOIN concept_ancestor x ON x.descendant_concept_id = c.condition_concept_id
        WHERE x.ancestor_concept_id < 1000000)""",
    "ancestor_concept_id", "condition_start_date", {"condition_group": 180},
)
VIEWS["x_drugs"] = flag_sql(
    "drug_exposure", "drug_concept_id", "drug_exposure_start_date",
    {"drug_long": 180, "drug_short": 30},
)
VIEWS["x_drug_eras"] = era_sql(
    "drug",
    {
        "drug_era_ever": "true",
        "drug_era_overlap": "drug_era_end_date >= cohort_start_date",
        "drug_era_long": "drug_era_end_date >= cohort_start_date - 180",
        "drug_era_short": "drug_era_end_date >= cohort_start_date - 30",
    },
)
VIEWS["x_procedures"] = flag_sql(
    "procedure_occurrence", "procedure_concept_id", "procedure_date",
    {"procedure_long": 180, "procedure_short": 30},
)
VIEWS["x_observations"] = (
    flag_sql(
        "observation", "observation_concept_id", "observation_date",
        {"observation_long": 180, "observation_short": 30},
    )
    + " UNION ALL "
    + count_sql(
        "observation", "observation_concept_id", "observation_date", "observation_count_long", 180
    )
)
VIEWS["x_measurements"] = (
    flag_sql(
        "measurement", "measurement_concept_id", "measurement_date",
        {"measurement_long": 180, "measurement_short": 30},
    )
    + " UNION ALL "
    + count_sql(
        "measurement", "measurement_concept_id", "measurement_date", "measurement_count_long", 180
    )
    + " UNION ALL "
    + flag_sql(
        "(SELECT * FROM measurement WHERE value_as_number < range_low)",
        "measurement_concept_id", "measurement_date", {"measurement_below": 180},
    )
    + " UNION ALL "
    + flag_sql(
        "(SELECT * FROM measurement WHERE value_as_number > range_high)",
        "measurement_concept_id", "measurement_date", {"measurement_above": 180},
    )
)
VIEWS["x_scores"] = f"""
    SELECT DISTINCT {ENTRY}, CAST(analysis AS BIGINT) AS covariate_id,
           CAST(score AS DOUBLE) AS covariate_value
    FROM arms JOIN (SELECT *, {A["charlson"]} AS analysis FROM charlson
                    UNION ALL SELECT *, {A["dcsi"]} FROM complications
                    UNION ALL SELECT *, {A["chads2"]} FROM chads2
                    UNION ALL SELECT *, {A["chads2vasc"]} FROM chads2vasc)
         USING (cohort_definition_id, subject_id) WHERE score <> 0"""
FAMILIES = (
    "demographics", "conditions", "inpatient", "condition_eras", "groups", "drugs", "drug_eras",
    "procedures", "observations", "measurements", "scores",
)
VIEWS["covariates"] = " UNION ALL ".join(f"SELECT * FROM x_{name}" for name in FAMILIES)

VIEWS["paired_covariates"] = """
    SELECT c.target_id, c.comparator_id, v.* FROM covariates v
    JOIN comparisons c ON v.cohort_definition_id IN (c.target_id, c.comparator_id)"""


def group_concepts(study):
    return study.cdm["concept"].filter("concept_id < 1000000").select("concept_id")


def scores_by_name(study):
    return {
        "charlson": charlson_like(study), "dcsi": complications(study), "chads2": chads2(study),
        "chads2vasc": chads2vasc(study),
    }


def risk_scores(study):
    parts = [X.score_covariate(entries(study), d, n) for n, d in scores_by_name(study).items()]
    return reduce(DataFrame.unionByName, parts)


def covariates(study):
    """The covariates the study queries use: all families."""

    def build(s):
        return X.all_families(entries(s), s.cdm, group_concepts(s), scores_by_name(s))

    return study.stage("covariates", build)


query("x1_x2_demographics", "SELECT * FROM x_demographics")(
    lambda s: X.demographics(entries(s), s.cdm["person"])
)
query("x3_condition_windows", "SELECT * FROM x_conditions UNION ALL SELECT * FROM x_inpatient")(
    lambda s: X.conditions(entries(s), s.cdm).unionByName(
        X.inpatient_conditions(entries(s), s.cdm)
    )
)
query("x4_condition_eras", "SELECT * FROM x_condition_eras")(
    lambda s: X.condition_eras(entries(s), s.cdm)
)
query("x5_condition_groups", "SELECT * FROM x_groups")(
    lambda s: X.condition_groups(entries(s), s.cdm, group_concepts(s))
)
query("x6_drug_windows", "SELECT * FROM x_drugs")(lambda s: X.drugs(entries(s), s.cdm))
query("x7_drug_eras", "SELECT * FROM x_drug_eras")(lambda s: X.drug_eras(entries(s), s.cdm))
query("x8_procedure_windows", "SELECT * FROM x_procedures")(
    lambda s: X.procedures(entries(s), s.cdm)
)
query("x9_observations", "SELECT * FROM x_observations")(
    lambda s: X.observations(entries(s), s.cdm)
)
query("x10_measurements", "SELECT * FROM x_measurements")(
    lambda s: X.measurements(entries(s), s.cdm)
)
query("x11_risk_scores", "SELECT * FROM x_scores")(risk_scores)
query(
    "x12_year_interaction",
    f"""SELECT {ENTRY}, (covariate_id * 1000 + year(cohort_start_date) - 1900) * 1000 + 990
               AS covariate_id, covariate_value FROM x_groups""",
)(lambda s: X.year_interaction(X.condition_groups(entries(s), s.cdm, group_concepts(s))))


@query(
    "x13_exclude_concepts",
    """SELECT * FROM covariates WHERE covariate_id % 1000 <= 100
          OR covariate_id // 1000 NOT IN (
              SELECT x.descendant_concept_id FROM concept_ancestor x
              JOIN items i ON i.concept_id = x.ancestor_concept_id WHERE i.codeset_id IN (28, 36))""",
)
def exclude(study):
    ids = design.items(study).filter("codeset_id in (28, 36)").select("concept_id")
    return X.exclude_concepts(covariates(study), ids, study.cdm["concept_ancestor"])


@query(
    "x14_drop_rare",
    f"""SELECT target_id, comparator_id, {ENTRY}, covariate_id, covariate_value
       FROM paired_covariates
       JOIN (SELECT target_id, comparator_id, covariate_id FROM paired_covariates GROUP BY ALL
             HAVING count(DISTINCT subject_id) >= 100) USING (target_id, comparator_id, covariate_id)""",
)
def rare(study):
    return X.drop_rare(covariates(study), design.comparisons(study), 100)


LISTED = (8507001, 8532001, 1999005)


@query(
    "x15_drop_listed",
    f"SELECT * FROM covariates WHERE covariate_id NOT IN {LISTED}",
)
def listed(study):
    ids = study.spark.createDataFrame([(i,) for i in LISTED], "covariate_id long")
    return X.drop_listed(covariates(study), ids)
