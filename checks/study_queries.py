"""Queries on study populations, propensity, matching and balance."""

import datetime

from pyspark.sql import functions as F

from checks import design
from checks.feature_queries import chads2, chads2vasc, covariates, days_with_diagnosis
from checks.registry import VIEWS, query
from twinarm.operators import balance as B
from twinarm.operators import cohorts as C
from twinarm.operators import families as X
from twinarm.operators import history as H
from twinarm.operators import matching as M
from twinarm.operators import population as P
from twinarm.operators import propensity as PS
from twinarm.operators.families import ENTRY
from twinarm.operators.demographics import age_groups

MODEL = P.MODEL
MODEL_SQL = "target_id, comparator_id, outcome_id"
ROW_SQL = "treatment, subject_id, cohort_start_date"


def grid(study, outcome_ids=design.OUTCOMES):
    rows = [(t, c, o) for t, c in design.COMPARISONS for o in outcome_ids]
    return study.spark.createDataFrame(rows, "target_id long, comparator_id long, outcome_id long")


def pairs(study):
    return P.exposure_pairs(
        design.arms(study), design.comparisons(study), study.cdm["observation_period"]
    )


def outcome_rows(study):
    return design.cohorts(study).filter(F.col("cohort_definition_id").isin(*design.OUTCOMES))


def population(study):
    return study.stage(
        "population", lambda s: P.study_population(pairs(s), grid(s), outcome_rows(s))
    )


def control_population(study):
    return study.stage(
        "control_population",
        lambda s: P.study_population(pairs(s), grid(s, design.CONTROLS), design.control_cohorts(s)),
    )


def cell_scores(study, rows):
    """Deterministic test score: treated share of the subject's gender, ten-year age and race."""
    who = study.cdm["person"].select(
        F.col("person_id").alias("subject_id"),
        "year_of_birth",
        "gender_concept_id",
        "race_concept_id",
    )
    cell = ["gender_concept_id", "race_concept_id", "decade"]
    known = rows.join(who, "subject_id").withColumn(
        "decade", F.floor((F.year("cohort_start_date") - F.col("year_of_birth")) / 10)
    )
    share = known.groupBy(*MODEL, *cell).agg(F.avg("treatment").alias("ps"))
    # A row for each model and cell, some hundreds however many the persons.
    return known.join(F.broadcast(share), [*MODEL, *cell]).drop(*cell, "year_of_birth")


def scored(study):
    return study.stage("scored", lambda s: cell_scores(s, population(s)))


def exact_matched(study):
    """1:1 match on equal scores: what the SQL side can state as ranks within a score."""
    return study.stage("exact_matched", lambda s: M.match(scored(s), MODEL, caliper=0.0))


VIEWS["exposure"] = """
    SELECT p.target_id, p.comparator_id, p.treatment, p.subject_id, p.cohort_start_date,
           p.cohort_end_date, o.op_end
    FROM pairs_of_arms p JOIN observation_period o ON o.person_id = p.subject_id
     AND p.cohort_start_date BETWEEN o.op_start AND o.op_end
    WHERE NOT EXISTS (SELECT 1 FROM pairs_of_arms q WHERE q.target_id = p.target_id
                        AND q.comparator_id = p.comparator_id AND q.subject_id = p.subject_id
                        AND q.treatment <> p.treatment)"""


def population_sql(outcomes, ids):
    return f"""
    SELECT w.*, date_diff('day', risk_start, risk_end) + 1 AS time_at_risk,
           EXISTS (SELECT 1 FROM {outcomes} x WHERE x.cohort_definition_id = w.outcome_id
                     AND x.subject_id = w.subject_id AND x.cohort_start_date < risk_start
                     AND x.cohort_start_date >= w.cohort_start_date - 99999) AS prior_outcome,
           (SELECT count(*) FROM {outcomes} x WHERE x.cohort_definition_id = w.outcome_id
              AND x.subject_id = w.subject_id
              AND x.cohort_start_date BETWEEN risk_start AND risk_end) AS outcome_count,
           (SELECT min(x.cohort_start_date) FROM {outcomes} x
            WHERE x.cohort_definition_id = w.outcome_id AND x.subject_id = w.subject_id
              AND x.cohort_start_date BETWEEN risk_start AND risk_end) AS first_event
    FROM (SELECT e.target_id, e.comparator_id, CAST(g.o AS BIGINT) AS outcome_id, e.treatment,
                 e.subject_id, e.cohort_start_date, e.cohort_end_date,
                 e.cohort_start_date + 1 AS risk_start,
                 least(e.cohort_end_date + 730, e.op_end) AS risk_end
          FROM exposure e, (VALUES {", ".join(f"({i})" for i in ids)}) g(o)) w"""


def final_sql(source):
    return f"""
    SELECT * EXCLUDE (prior_outcome, first_event),
           date_diff('day', risk_start, first_event) AS days_to_event,
           coalesce(date_diff('day', risk_start, first_event) + 1, time_at_risk) AS survival_time
    FROM {source} WHERE NOT prior_outcome AND time_at_risk >= 1"""


VIEWS["windowed"] = population_sql("outcomes", design.OUTCOMES)
VIEWS["population"] = final_sql("windowed")
VIEWS["control_windowed"] = population_sql("controls", design.CONTROLS)
VIEWS["control_population"] = final_sql("control_windowed")
SCORE_SQL = f"""
    SELECT s.* EXCLUDE (gender, race, decade),
           avg(treatment) OVER (PARTITION BY {MODEL_SQL}, gender, race, decade) AS ps
    FROM (SELECT q.*, p.gender_concept_id AS gender, p.race_concept_id AS race,
                 (year(q.cohort_start_date) - p.year_of_birth) // 10 AS decade
          FROM {{source}} q JOIN person p ON p.person_id = q.subject_id) s"""
MATCH_SQL = f"""
    SELECT s.* EXCLUDE (k, place, size),
           k || '-' || (place - 1) AS stratum_id
    FROM (SELECT r.*, min(n) OVER (PARTITION BY {MODEL_SQL}, k) AS size
          FROM (SELECT q.*, CAST(round(ps * 1000000000) AS BIGINT) AS k,
                       row_number() OVER (PARTITION BY {MODEL_SQL}, treatment,
                           round(ps * 1000000000)
                           ORDER BY subject_id, cohort_start_date) AS place,
                       count(*) OVER (PARTITION BY {MODEL_SQL}, treatment,
                           round(ps * 1000000000)) AS n
                FROM {{source}} q) r
          QUALIFY min(treatment) OVER (PARTITION BY {MODEL_SQL}, k)
               <> max(treatment) OVER (PARTITION BY {MODEL_SQL}, k)) s
    WHERE place <= size"""
VIEWS["scored"] = SCORE_SQL.format(source="population")
VIEWS["matched"] = MATCH_SQL.format(source="scored").replace("(k, place, size)", "(k, place, n, size)")


@query(
    "p1_exposure_pairs",
    """SELECT target_id, comparator_id, treatment, subject_id, cohort_start_date, cohort_end_date
       FROM exposure""",
)
def exposure(study):
    return pairs(study).drop("op_end_date")


@query(
    "p1_first_exposure_washout",
    """SELECT e.target_id, e.comparator_id, e.treatment, e.subject_id, e.cohort_start_date
       FROM exposure e JOIN observation_period o ON o.person_id = e.subject_id
       WHERE o.op_start + 400 <= e.cohort_start_date
         AND e.cohort_start_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
)
def washout(study):
    return P.exposure_pairs(
        design.arms(study),
        design.comparisons(study),
        study.cdm["observation_period"],
        first_exposure_only=True,
        washout_days=400,
        study_start=datetime.date(1997, 1, 1),
        study_end=datetime.date(1999, 12, 31),
    ).drop("cohort_end_date", "op_end_date")


@query(
    "p2_prior_outcome",
    f"SELECT {MODEL_SQL}, {ROW_SQL}, prior_outcome FROM windowed",
)
def prior(study):
    return P.with_outcomes(pairs(study), grid(study), outcome_rows(study)).select(
        *MODEL, *P.ROW, "prior_outcome"
    )


@query(
    "p3_time_at_risk",
    f"SELECT {MODEL_SQL}, {ROW_SQL}, risk_start, risk_end, time_at_risk FROM windowed",
)
def at_risk(study):
    return P.with_outcomes(pairs(study), grid(study), outcome_rows(study)).select(
        *MODEL, *P.ROW, "risk_start", "risk_end", "time_at_risk"
    )


@query(
    "p4_min_days",
    f"""SELECT {MODEL_SQL}, treatment, count(*) AS subjects FROM windowed
        WHERE time_at_risk >= 30 GROUP BY ALL""",
)
def min_days(study):
    return (
        P.study_population(
            pairs(study),
            grid(study),
            outcome_rows(study),
            remove_prior_outcome=False,
            min_days_at_risk=30,
        )
        .groupBy(*MODEL, "treatment")
        .agg(F.count("*").alias("subjects"))
    )


@query(
    "p5_study_population",
    f"""SELECT {MODEL_SQL}, {ROW_SQL}, cohort_end_date, risk_start, risk_end, time_at_risk,
               outcome_count, days_to_event, survival_time FROM population""",
)
def full_population(study):
    return P.study_population(pairs(study), grid(study), outcome_rows(study))


@query(
    "p6_propensity",
    f"""SELECT {MODEL_SQL}, count(*) AS subjects, sum(treatment) AS mean_ps_times_subjects,
               true AS converged, 0 AS broken_conditions
        FROM population GROUP BY {MODEL_SQL}""",
)
def propensity(study):
    """L1 logistic scores of every model on all families. What SQL can tell: an intercept that is not
    penalised makes the mean score the treated share, and no optimality condition is broken."""
    pop, cov = population(study), covariates(study)
    scored, fits, coefficients = PS.propensity_fits(pop, cov)
    # Conditions from the scores alone: gradients by covariate, against the penalty of the fit.
    rows = PS.entry_of(scored).select(*MODEL, *ENTRY, (F.col("ps") - F.col("treatment")).alias("residual"))
    largest = rows.join(cov, ENTRY).groupBy(*MODEL, "covariate_id").agg(
        F.max(F.abs("covariate_value")).alias("largest"),
        F.sum(F.col("covariate_value") * F.col("residual")).alias("slope"),
    )
    sizes = scored.groupBy(*MODEL).agg(F.count("*").alias("subjects"), F.sum("ps").alias("all_ps"))
    told = (
        largest.filter("largest > 0")
        .join(coefficients, [*MODEL, "covariate_id"], "left")
        .join(F.broadcast(fits), MODEL)
        .join(F.broadcast(sizes), MODEL)
    )
    slope, penalty = F.col("slope") / F.col("largest"), F.sqrt(2.0 / F.col("variance"))
    away = F.when(
        F.coalesce("coefficient", F.lit(0.0)) == 0, F.greatest(F.abs(slope) - penalty, F.lit(0.0))
    ).otherwise(F.abs(slope + penalty * F.signum("coefficient")))
    broken = told.groupBy(*MODEL).agg(
        F.sum(F.when(away > 1e-4 * F.col("subjects"), 1).otherwise(0)).alias("broken_conditions")
    )
    # To the nearest subject: the intercept's condition is met far more closely.
    return (
        sizes.join(fits.select(*MODEL, "converged"), MODEL)
        .join(broken, MODEL)
        .withColumn("mean_ps_times_subjects", F.round("all_ps").cast("long"))
        .drop("all_ps")
    )


SCORE_COVARIATE, PRIOR_VARIANCE = X.ANALYSIS["chads2vasc"], 0.1
VIEWS["score_population"] = f"""
    SELECT {MODEL_SQL}, treatment AS y, x / largest AS x, x / largest - avg(x / largest) OVER (PARTITION BY {MODEL_SQL}) AS c, largest
    FROM (SELECT p.*, coalesce(v.covariate_value, 0) AS x, max(abs(v.covariate_value)) OVER (PARTITION BY {MODEL_SQL}) AS largest
          FROM (SELECT *, CASE WHEN treatment = 1 THEN target_id ELSE comparator_id END AS cohort_definition_id FROM population) p
          LEFT JOIN (SELECT * FROM x_scores WHERE covariate_id = {SCORE_COVARIATE}) v
            USING (cohort_definition_id, subject_id, cohort_start_date))"""
# Damped Newton steps for the intercept, damped soft-thresholded ones for the centred score, side by side.
VIEWS["score_propensity"] = f"""
    WITH RECURSIVE steps AS (
      SELECT {MODEL_SQL}, 0 AS k, ln(avg(y) / (1 - avg(y)))::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM score_population GROUP BY {MODEL_SQL}
      UNION ALL
      SELECT {MODEL_SQL}, k + 1, b0 + 0.8 * g0 / h00,
             0.2 * b1 + 0.8 * sign(b1 + g1 / h11) * greatest(abs(b1 + g1 / h11) - sqrt(2.0 / {PRIOR_VARIANCE}) / h11, 0)
      FROM (SELECT {MODEL_SQL}, any_value(k) AS k, any_value(b0) AS b0, any_value(b1) AS b1, sum(y - q) AS g0, sum(c * (y - q)) AS g1,
                   sum(q * (1 - q)) AS h00, sum(c * c * q * (1 - q)) AS h11
            FROM (SELECT s.*, y, c, 1 / (1 + exp(-b0 - b1 * c)) AS q FROM steps s JOIN score_population USING ({MODEL_SQL}) WHERE k < 120)
            GROUP BY {MODEL_SQL}))
    SELECT {MODEL_SQL}, b0 - b1 * mean AS intercept, CASE WHEN abs(b1) < 1e-9 THEN 0 ELSE b1 / largest END AS coefficient
    FROM steps JOIN (SELECT {MODEL_SQL}, avg(x) AS mean, any_value(largest) AS largest FROM score_population GROUP BY {MODEL_SQL})
      USING ({MODEL_SQL}) WHERE k = 120"""


@query(
    "p6_one_covariate",
    f"""SELECT {MODEL_SQL}, round(intercept, 5) AS intercept, round(coefficient, 5) AS coefficient FROM score_propensity""",
)
def propensity_on_a_score(study):
    """The model of treatment on one risk score at a fixed variance, solved by other steps in SQL."""
    score = covariates(study).filter(F.col("covariate_id") == SCORE_COVARIATE)
    _, _, inside = PS.propensity_fits(population(study), score, variance=PRIOR_VARIANCE, tolerance=1e-10)
    value = F.max(F.when(F.col("covariate_id") == SCORE_COVARIATE, F.col("coefficient")))
    return inside.groupBy(*MODEL).agg(
        F.round(F.max(F.when(F.col("covariate_id") == 0, F.col("coefficient"))), 5).alias("intercept"),
        F.round(F.coalesce(value, F.lit(0.0)), 5).alias("coefficient"),
    )


VIEWS["entered"] = f"""
    SELECT {MODEL_SQL}, CASE WHEN cohort_definition_id = target_id THEN 1 ELSE 0 END AS treatment, subject_id
    FROM (SELECT target_id, comparator_id, CAST(o AS BIGINT) AS outcome_id FROM comparisons,
            (VALUES {", ".join(f"({o})" for o in design.OUTCOMES)}) AS v(o))
    JOIN arms ON cohort_definition_id IN (target_id, comparator_id)"""


@query(
    "c28_study_attrition",
    f"""SELECT {MODEL_SQL}, treatment, step, any_value(label) AS label, count(DISTINCT subject_id) AS subjects
        FROM (SELECT {MODEL_SQL}, treatment, subject_id, 0 AS step, 'cohort entry' AS label FROM entered
              UNION ALL SELECT {MODEL_SQL}, treatment, subject_id, 1, 'in one arm only' FROM windowed
              UNION ALL SELECT {MODEL_SQL}, treatment, subject_id, 2, 'no earlier outcome' FROM windowed WHERE NOT prior_outcome
              UNION ALL SELECT {MODEL_SQL}, treatment, subject_id, 3, 'enough time at risk' FROM population
              UNION ALL SELECT {MODEL_SQL}, treatment, subject_id, 4, 'matched' FROM matched)
        GROUP BY {MODEL_SQL}, treatment, step""",
)
def attrition_to_the_end(study):
    """From cohort entry to the matched set, per model and arm, as one aggregate over one number a subject."""
    judged = P.with_outcomes(pairs(study), grid(study), outcome_rows(study))
    return C.study_attrition(design.arms(study), grid(study), judged, exact_matched(study))


ENTRY_SQL = "CASE WHEN treatment = 1 THEN target_id ELSE comparator_id END"
VIEWS["long_rows"] = f"""
    SELECT p.target_id, p.comparator_id, p.outcome_id, p.treatment, p.subject_id, p.kept,
           c.covariate_id, c.covariate_value AS x
    FROM (SELECT q.*, m.stratum_id IS NOT NULL AS kept, CASE WHEN q.treatment = 1
                 THEN q.target_id ELSE q.comparator_id END AS cohort_definition_id
          FROM population q
          LEFT JOIN matched m USING ({MODEL_SQL}, {ROW_SQL})) p
    JOIN covariates c USING (cohort_definition_id, subject_id, cohort_start_date)"""
VIEWS["sizes"] = f"""
    SELECT {MODEL_SQL}, count(*) AS n, sum(treatment) AS n1, count(*) - sum(treatment) AS n0,
           count(m.stratum_id) FILTER (treatment = 1) AS m1,
           count(m.stratum_id) FILTER (treatment = 0) AS m0
    FROM population q LEFT JOIN (SELECT {MODEL_SQL}, {ROW_SQL}, stratum_id FROM matched) m
         USING ({MODEL_SQL}, {ROW_SQL})
    GROUP BY {MODEL_SQL}"""


@query(
    "p7_correlation",
    f"""SELECT {MODEL_SQL}, covariate_id,
               round((n * sxy - sx * n1) / sqrt((n * sxx - sx * sx) * (n * n1 - n1 * n1)), 6)
                   AS correlation
        FROM (SELECT {MODEL_SQL}, covariate_id, sum(x) AS sx, sum(x * x) AS sxx,
                     sum(x * treatment) AS sxy FROM long_rows GROUP BY ALL)
        JOIN sizes USING ({MODEL_SQL}) WHERE n * sxx - sx * sx > 0""",
)
def correlation(study):
    return (
        PS.treatment_correlation(population(study), covariates(study))
        .filter("correlation is not null")
        .withColumn("correlation", F.round("correlation", 6))
    )


VIEWS["preferred"] = f"""
    SELECT *, CASE WHEN ps <= 0 THEN 0.0 WHEN ps >= 1 THEN 1.0
                   ELSE 1 / (1 + exp(-(ln(ps / (1 - ps)) - ln(share / (1 - share))))) END
                   AS preference
    FROM (SELECT *, avg(treatment) OVER (PARTITION BY {MODEL_SQL}) AS share FROM scored)"""


@query(
    "p8_preference_score",
    f"SELECT {MODEL_SQL}, {ROW_SQL}, round(preference, 10) AS preference FROM preferred",
)
def preference(study):
    return PS.preference_score(scored(study)).select(
        *MODEL, *P.ROW, F.round("preference", 10).alias("preference")
    )


@query(
    "p8_preference_histogram",
    f"""SELECT {MODEL_SQL}, treatment, bin, count(*) AS subjects,
               round(count(*) / any_value(arm), 6) AS share
        FROM (SELECT *, least(CAST(floor(preference * 20) AS INTEGER), 19) AS bin,
                     count(*) OVER (PARTITION BY {MODEL_SQL}, treatment) AS arm FROM preferred)
        GROUP BY {MODEL_SQL}, treatment, bin""",
)
def histogram(study):
    return PS.preference_histogram(PS.preference_score(scored(study))).withColumn(
        "share", F.round("share", 6)
    )


@query(
    "p9_match_exact",
    f"SELECT {MODEL_SQL}, {ROW_SQL}, stratum_id FROM matched",
)
def match_exact(study):
    return M.match(scored(study), MODEL, caliper=0.0).select(*MODEL, *P.ROW, "stratum_id")


# Sequential greedy over score groups by (distance, mix, scores), all models side by side: every step
# takes the closest pair of each model with subjects left on both sides.
VIEWS["score_groups"] = f"""
    SELECT {MODEL_SQL}, treatment, CAST(round(ps * 1000000000) AS BIGINT) AS k, count(*) AS n
    FROM scored GROUP BY ALL"""
VIEWS["widths"] = f"""
    SELECT {MODEL_SQL}, floor(0.25 * stddev_samp(ps) * 1000000000) AS width
    FROM scored GROUP BY ALL"""
GREEDY_SQL = f"""
    WITH RECURSIVE greedy(target_id, comparator_id, outcome_id, step, t, c, d, mix, nt, nc, pick, take) AS (
        SELECT {MODEL_SQL}, 0, t.k, c.k, abs(t.k - c.k),
               (t.k * {M.MIX_T} + c.k * {M.MIX_C}) % {M.MIX_MOD}, t.n, c.n, false, CAST(0 AS BIGINT)
        FROM (SELECT * FROM score_groups WHERE treatment = 1) t
        JOIN (SELECT * FROM score_groups WHERE treatment = 0) c USING ({MODEL_SQL})
        JOIN widths USING ({MODEL_SQL})
        WHERE abs(t.k - c.k) <= width
        UNION ALL
        SELECT {MODEL_SQL}, step + 1, t, c, d, mix,
               nt - CASE WHEN t = pt THEN best ELSE 0 END,
               nc - CASE WHEN c = pc THEN best ELSE 0 END,
               t = pt AND c = pc, CASE WHEN t = pt AND c = pc THEN best ELSE 0 END
        FROM (SELECT g.*, first_value(t) OVER w AS pt, first_value(c) OVER w AS pc,
                     first_value(least(nt, nc)) OVER w AS best
              FROM greedy g WHERE nt > 0 AND nc > 0
              WINDOW w AS (PARTITION BY {MODEL_SQL} ORDER BY d, mix, t, c
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    )
    SELECT {MODEL_SQL}, t AS t_score, c AS c_score, take AS matched FROM greedy WHERE pick"""


@query("p9_match_caliper", GREEDY_SQL)
def match_caliper(study):
    matched = M.match(scored(study), MODEL, caliper=0.25)
    score = F.round(F.col("ps") * M.SCORE_UNIT).cast("long")
    sides = matched.groupBy(*MODEL, "stratum_id").agg(
        F.max(F.when(F.col("treatment") == 1, score)).alias("t_score"),
        F.max(F.when(F.col("treatment") == 0, score)).alias("c_score"),
    )
    return sides.groupBy(*MODEL, "t_score", "c_score").agg(F.count("*").alias("matched"))


# With equal scores, treated subject i of a score and gender takes comparator i, then n + i.
VIEWS["ratio_places"] = f"""
    SELECT s.*, CAST(round(ps * 1000000000) AS BIGINT) AS k, p.gender_concept_id,
           row_number() OVER (PARTITION BY {MODEL_SQL}, gender_concept_id, round(ps * 1000000000), treatment
                              ORDER BY subject_id, cohort_start_date) - 1 AS place,
           least(sum(treatment) OVER g, sum(1 - treatment) OVER g) AS pairs
    FROM scored s JOIN person p ON p.person_id = s.subject_id
    WINDOW g AS (PARTITION BY {MODEL_SQL}, gender_concept_id, round(ps * 1000000000))"""


@query(
    "p10_match_ratio",
    f"""SELECT {MODEL_SQL}, {ROW_SQL}, gender_concept_id,
               k || '-' || CAST(CASE WHEN treatment = 1 THEN place ELSE place % pairs END AS BIGINT)
                   AS stratum_id
        FROM ratio_places WHERE pairs > 0 AND place < CASE WHEN treatment = 1 THEN pairs ELSE 2 * pairs END""",
)
def match_ratio(study):
    """Up to two comparators of the same score per treated subject, within gender."""
    who = study.cdm["person"].select(F.col("person_id").alias("subject_id"), "gender_concept_id")
    rows = scored(study).join(who, "subject_id")
    return M.match(rows, MODEL, 0.0, max_ratio=2, strata=("gender_concept_id",)).select(
        *MODEL, *P.ROW, "gender_concept_id", "stratum_id"
    )


def balanced(study):
    return study.stage(
        "balance", lambda s: B.balance(population(s), exact_matched(s), covariates(s))
    )


def mean_sd(stage, arm, n):
    keep = f"treatment = {arm}" + (" AND kept" if stage == "after" else "")
    sx = f"coalesce(sum(x) FILTER ({keep}), 0)"
    sxx = f"coalesce(sum(x * x) FILTER ({keep}), 0)"
    mean = f"{sx} / nullif(any_value({n}), 0)"
    square = f"({sxx} - any_value({n}) * ({mean}) * ({mean})) / nullif(any_value({n}) - 1, 0)"
    sd = f"sqrt(CASE WHEN {square} < 0 THEN 0 ELSE {square} END)"
    return mean, sd


def balance_columns():
    out = []
    for stage, n in (("before", "n"), ("after", "m")):
        for arm, label in ((1, "target"), (0, "comparator")):
            mean, sd = mean_sd(stage, arm, f"{n}{arm}")
            out += [f"{mean} AS {stage}_mean_{label}", f"{sd} AS {stage}_sd_{label}"]
    return ", ".join(out)


VIEWS["balance_parts"] = f"""
    SELECT {MODEL_SQL}, covariate_id, {balance_columns()}
    FROM long_rows JOIN sizes USING ({MODEL_SQL}) GROUP BY {MODEL_SQL}, covariate_id"""
VIEWS["balanced"] = f"""
    SELECT *, {", ".join(f'''(s.{g}_mean_target - s.{g}_mean_comparator)
        / nullif(sqrt((pow(s.{g}_sd_target, 2) + pow(s.{g}_sd_comparator, 2)) / 2), 0)
        AS {g}_std_diff''' for g in ("before", "after"))}
    FROM balance_parts s"""
BALANCE_NAMES = [
    f"{g}_{c}"
    for g in ("before", "after")
    for c in ("mean_target", "sd_target", "mean_comparator", "sd_comparator", "std_diff")
]


def six_sql(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def six(df, names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(
    "p11_balance",
    f"SELECT {MODEL_SQL}, covariate_id, {six_sql(BALANCE_NAMES)} FROM balanced",
)
def balance_query(study):
    return six(
        B.balance(population(study), exact_matched(study), covariates(study)), BALANCE_NAMES
    )


@query(
    "p12_unbalanced",
    f"""SELECT {MODEL_SQL}, covariate_id, round(abs(before_std_diff), 6) AS before_std_diff_abs,
               round(abs(after_std_diff), 6) AS after_std_diff_abs
        FROM balanced WHERE abs(after_std_diff) > 0.1""",
)
def unbalanced(study):
    out = B.absolute_balance(balanced(study), only_unbalanced=True)
    names = ["before_std_diff_abs", "after_std_diff_abs"]
    return six(out.select(*MODEL, "covariate_id", *names), names)


@query(
    "p13_top_unbalanced",
    f"""SELECT ranked_by, {MODEL_SQL}, covariate_id, {six_sql(["before_std_diff", "after_std_diff"])}
        FROM (SELECT 'before' AS ranked_by, * FROM balanced WHERE before_std_diff IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY {MODEL_SQL}
                  ORDER BY round(abs(before_std_diff), 9) DESC, covariate_id) <= 20
              UNION ALL
              SELECT 'after' AS ranked_by, * FROM balanced WHERE after_std_diff IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY {MODEL_SQL}
                  ORDER BY round(abs(after_std_diff), 9) DESC, covariate_id) <= 20)""",
)
def top(study):
    names = ["before_std_diff", "after_std_diff"]
    mine = balanced(study)
    for n in names:
        mine = mine.withColumn(n, F.round(n, 9))
    return six(B.top_unbalanced(mine, 20).select("ranked_by", *MODEL, "covariate_id", *names), names)


@query(
    "p14_balance_scatter",
    f"""SELECT {MODEL_SQL}, covariate_id, round(abs(before_std_diff), 6) AS before_std_diff_abs,
               round(abs(after_std_diff), 6) AS after_std_diff_abs FROM balanced""",
)
def scatter(study):
    return six(
        B.balance_scatter(balanced(study)), ["before_std_diff_abs", "after_std_diff_abs"]
    )


KEYS = MODEL


def after_match_rows(study):
    rows = H.arm_rows(design.arms(study), grid(study))
    return H.with_after_match(rows, exact_matched(study), KEYS)


VIEWS["marked_arms"] = f"""
    SELECT p.target_id, p.comparator_id, o.outcome_id, p.cohort_definition_id, p.treatment,
           p.subject_id, p.cohort_start_date,
           CASE WHEN m.subject_id IS NULL THEN 0 ELSE 1 END AS after_match
    FROM pairs_of_arms p
    JOIN (VALUES (CAST(11 AS BIGINT)), (12)) o(outcome_id) ON true
    LEFT JOIN (SELECT DISTINCT {MODEL_SQL}, treatment, subject_id FROM matched) m
      ON m.target_id = p.target_id AND m.comparator_id = p.comparator_id
     AND m.outcome_id = o.outcome_id AND m.treatment = p.treatment
     AND m.subject_id = p.subject_id"""


@query(
    "f8_after_match",
    f"""SELECT {MODEL_SQL}, treatment, subject_id, after_match FROM marked_arms""",
)
def after_match(study):
    return after_match_rows(study).select(*MODEL, "treatment", "subject_id", "after_match")


@query(
    "f10_covariate_rows",
    f"""SELECT {MODEL_SQL}, treatment, subject_id, age_group AS category, age_at_index AS score,
               after_match
        FROM marked_arms JOIN age_bands USING (cohort_definition_id, subject_id)""",
)
def covariate_rows(study):
    return H.covariate_rows(
        age_groups(design.arms(study), study.cdm["person"]),
        grid(study),
        exact_matched(study),
        KEYS,
        "age_at_index",
        "age_group",
    )


def score_tables(study):
    """Score covariates of Table 1 by label, each a stored derived table."""
    return {
        "Age at index": study.stage("cohort_agegroups", age_table).withColumn(
            "score", F.col("age_at_index")
        ),
        "CHADS2": study.stage("chads2", chads2),
        "CHADS2-VASc": study.stage("chads2vasc", chads2vasc),
        "Days with diagnosis": study.stage("diagnosis_days", days_with_diagnosis),
    }


def age_table(study):
    return age_groups(design.arms(study), study.cdm["person"])
