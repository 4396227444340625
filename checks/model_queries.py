"""Queries on outcome models, summaries and calibration."""

import math

from pyspark.sql import functions as F

from checks import design
from checks.feature_queries import covariates, group_concepts, scores_by_name
from checks.registry import VIEWS, query
from checks.study_queries import (
    MATCH_SQL,
    MODEL,
    MODEL_SQL,
    PRIOR_VARIANCE,
    SCORE_SQL,
    cell_scores,
    control_population,
    exact_matched,
    grid,
    outcome_rows,
    six,
    six_sql,
)
from twinarm.functions.mathx import NORMAL_CDF_B, NORMAL_CDF_P
from twinarm.functions.names import display_name, underscored_name
from twinarm.operators import calibration as K
from twinarm.operators import matching as M
from twinarm.operators import summary as S
from twinarm.operators import families as X
from twinarm.operators.cox import TREATMENT, cox_fits, cox_grid, cox_pairs, pair_counts
from twinarm.operators.families import ENTRY
from twinarm.operators.propensity import entry_of
from twinarm.plans.study import StudySettings, run_study

NAMES = (
    (1, "[Tag-1] Procedure arm A"),
    (2, "[Tag-1] Procedure arm B"),
    (3, "[Tag-1] Drug_arm C"),
)


def control_matched(study):
    return study.stage(
        "control_matched",
        lambda s: M.match(cell_scores(s, control_population(s)), MODEL, caliper=0.0),
    )


def outcome_summary(study):
    matched = exact_matched(study)
    return S.summarize_models(cox_pairs(matched), matched)


def control_summary(study):
    matched = control_matched(study)
    return S.summarize_models(cox_pairs(matched), matched)


def total_summary(study):
    return study.stage(
        "total_summary",
        lambda s: S.complete_cases(S.stack_summaries(control_summary(s), outcome_summary(s))),
    )


def posterior(study):
    def build(s):
        controls = total_summary(s).filter(F.col("outcome_id").isin(*design.CONTROLS))
        return K.null_posterior(controls)

    return study.stage("posterior", build)


def pairs_sql(source):
    return f"""
    SELECT {MODEL_SQL}, count(*) FILTER (te AND tt <= ct) AS n10,
           count(*) FILTER (ce AND ct <= tt) AS n01
    FROM (SELECT a.target_id, a.comparator_id, a.outcome_id, a.survival_time AS tt,
                 b.survival_time AS ct, a.outcome_count > 0 AS te, b.outcome_count > 0 AS ce
          FROM {source} a JOIN {source} b USING ({MODEL_SQL}, stratum_id)
          WHERE a.treatment = 1 AND b.treatment = 0)
    GROUP BY {MODEL_SQL}"""


def fits_sql(source):
    return f"""
    SELECT {MODEL_SQL}, CASE WHEN n10 > 0 AND n01 > 0 THEN ln(n10 / n01) END AS log_rr,
           CASE WHEN n10 > 0 AND n01 > 0 THEN sqrt(1 / n10 + 1 / n01) END AS se_log_rr
    FROM {source}"""


def summary_sql(matched, fits):
    return f"""
    SELECT '1' AS analysis_id, t.*, f.log_rr, f.se_log_rr
    FROM (SELECT {MODEL_SQL},
                 sum(treatment) AS treated, sum(1 - treatment) AS comparator,
                 sum(treatment * survival_time) AS treated_days,
                 sum((1 - treatment) * survival_time) AS comparator_days,
                 sum(CASE WHEN outcome_count > 0 THEN treatment ELSE 0 END) AS events_treated,
                 sum(CASE WHEN outcome_count > 0 THEN 1 - treatment ELSE 0 END)
                     AS events_comparator
          FROM {matched} GROUP BY {MODEL_SQL}) t
    LEFT JOIN {fits} f USING ({MODEL_SQL})"""


VIEWS["control_scored"] = SCORE_SQL.format(source="control_population")
VIEWS["control_matched"] = MATCH_SQL.format(source="control_scored").replace(
    "(k, place, size)", "(k, place, n, size)"
)
VIEWS["pair_counts"] = pairs_sql("matched")
VIEWS["control_pair_counts"] = pairs_sql("control_matched")
VIEWS["fits"] = fits_sql("pair_counts")
VIEWS["control_fits"] = fits_sql("control_pair_counts")
VIEWS["outcome_summary"] = summary_sql("matched", "fits")
VIEWS["control_summary"] = summary_sql("control_matched", "control_fits")
VIEWS["total_summary"] = """
    SELECT * FROM (SELECT * FROM control_summary UNION ALL SELECT * FROM outcome_summary)
    WHERE log_rr IS NOT NULL AND se_log_rr IS NOT NULL"""
SUMMARY_SQL = f"""analysis_id, {MODEL_SQL}, treated, comparator, treated_days, comparator_days,
    events_treated, events_comparator, {six_sql(["log_rr", "se_log_rr"])}"""
ESTIMATE = ["log_rr", "se_log_rr"]


@query("m1_pair_counts", "SELECT * FROM pair_counts")
def counts(study):
    return pair_counts(exact_matched(study))


@query("m1_cox_pairs", f"SELECT {MODEL_SQL}, {six_sql(ESTIMATE)} FROM fits")
def pairs_query(study):
    return six(cox_pairs(exact_matched(study)), ESTIMATE)


@query(
    "m2_cox_iterative",
    f"SELECT {MODEL_SQL}, {six_sql(ESTIMATE)} FROM fits",
)
def iterative(study):
    """The iterative Cox fit without covariates must agree with the closed form."""
    fitted = cox_grid(exact_matched(study), tolerance=1e-10).drop("converged", "iterations")
    return six(fitted, ESTIMATE)


SCORE_COVARIATE = X.ANALYSIS["chads2vasc"]
L1 = math.sqrt(2.0)
VIEWS["score_rows"] = f"""
    SELECT m.*, coalesce(x.covariate_value, 0) AS x
    FROM (SELECT *, CASE WHEN treatment = 1 THEN target_id ELSE comparator_id END AS cohort_definition_id FROM matched) m
    LEFT JOIN (SELECT * FROM x_scores WHERE covariate_id = {SCORE_COVARIATE}) x
      USING (cohort_definition_id, subject_id, cohort_start_date)"""
# An event while the partner is at risk: who had it, less the partner.
VIEWS["pair_events"] = f"""
    SELECT {MODEL_SQL}, d0, d1 / nullif(largest, 0) AS d1, largest
    FROM (SELECT a.target_id, a.comparator_id, a.outcome_id, a.treatment - b.treatment AS d0, a.x - b.x AS d1,
                 max(greatest(a.x, b.x)) OVER (PARTITION BY a.target_id, a.comparator_id, a.outcome_id) AS largest
          FROM score_rows a JOIN score_rows b USING ({MODEL_SQL}, stratum_id)
          WHERE a.treatment <> b.treatment AND a.outcome_count > 0 AND b.survival_time >= a.survival_time)"""
# Damped Newton steps for treatment, damped soft-thresholded ones for the score, side by side.
VIEWS["score_fits"] = f"""
    WITH RECURSIVE told AS (
      SELECT {MODEL_SQL}, d0, coalesce(d1, 0) AS d1, largest FROM pair_events
      QUALIFY min(d0) OVER (PARTITION BY {MODEL_SQL}) < 0 AND max(d0) OVER (PARTITION BY {MODEL_SQL}) > 0),
    steps AS (
      SELECT DISTINCT {MODEL_SQL}, 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM told
      UNION ALL
      SELECT {MODEL_SQL}, k + 1, b0 + 0.7 * g0 / h00,
             CASE WHEN h11 > 0 THEN 0.3 * b1 + 0.7 * sign(b1 + g1 / h11) * greatest(abs(b1 + g1 / h11) - {L1} / h11, 0) ELSE 0 END
      FROM (SELECT {MODEL_SQL}, any_value(k) AS k, any_value(b0) AS b0, any_value(b1) AS b1, sum(d0 * q) AS g0, sum(d1 * q) AS g1,
                   sum(d0 * d0 * q * (1 - q)) AS h00, sum(d1 * d1 * q * (1 - q)) AS h11
            FROM (SELECT s.*, d0, d1, 1 / (1 + exp(d0 * b0 + d1 * b1)) AS q FROM steps s JOIN told USING ({MODEL_SQL}) WHERE k < 300)
            GROUP BY {MODEL_SQL}))
    SELECT {MODEL_SQL}, b0 AS log_rr, CASE WHEN abs(b1) < 1e-9 THEN 0 ELSE b1 / largest END AS coefficient,
           1 / sqrt(CASE WHEN abs(b1) < 1e-9 THEN h00 ELSE h00 - h01 * h01 / h11 END) AS se_log_rr
    FROM (SELECT {MODEL_SQL}, any_value(b0) AS b0, any_value(b1) AS b1, any_value(largest) AS largest, sum(d0 * d0 * q * (1 - q)) AS h00,
                 sum(d0 * d1 * q * (1 - q)) AS h01, sum(d1 * d1 * q * (1 - q)) AS h11
          FROM (SELECT s.*, d0, d1, largest, 1 / (1 + exp(d0 * b0 + d1 * b1)) AS q FROM steps s JOIN told USING ({MODEL_SQL}) WHERE k = 300)
          GROUP BY {MODEL_SQL})"""


@query(
    "m2_cox_covariate",
    f"""SELECT {MODEL_SQL}, round(f.log_rr, 5) AS log_rr, round(f.se_log_rr, 5) AS se_log_rr, round(coalesce(coefficient, 0), 5) AS coefficient
        FROM pair_counts LEFT JOIN score_fits f USING ({MODEL_SQL})""",
)
def one_covariate(study):
    """Treatment adjusted for one risk score under the study's prior, with the error that follows from both."""
    score = covariates(study).filter(F.col("covariate_id") == SCORE_COVARIATE)
    fits, inside = cox_fits(exact_matched(study), score, l1=L1, tolerance=1e-10)
    own = inside.filter(F.col("covariate_id") == SCORE_COVARIATE).select(*MODEL, "coefficient")
    out = fits.join(own, MODEL, "left").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))
    return out.select(*MODEL, *[F.round(c, 5).alias(c) for c in (*ESTIMATE, "coefficient")])


@query(
    "m2_cox_study",
    f"""SELECT {MODEL_SQL}, n10 + n01 AS events, n10 > 0 AND n01 > 0 AS converged, 0 AS broken_conditions FROM pair_counts""",
)
def all_covariates(study):
    """Every outcome model on all covariate families, as the study has it. The optimality conditions are
    restated from the coefficients alone, without the code that fitted them: the slope of each covariate
    over the pairs, against the penalty."""
    matched, cov = exact_matched(study), covariates(study)
    fits, inside = cox_fits(matched, cov, l1=L1)
    entry = [*MODEL, "stratum_id", "treatment"]
    rows = entry_of(matched).select(*entry, *ENTRY, "survival_time", (F.col("outcome_count") > 0).alias("event"))
    values = rows.join(cov, ENTRY).groupBy(*entry, "covariate_id").agg(F.sum("covariate_value").alias("x"))
    effects = values.join(F.broadcast(inside), [*MODEL, "covariate_id"]).groupBy(*entry).agg(F.sum(F.col("x") * F.col("coefficient")).alias("eta"))
    own = F.broadcast(inside.filter(F.col("covariate_id") == TREATMENT).select(*MODEL, F.col("coefficient").alias("effect")))
    known = rows.join(effects, entry, "left").join(own, MODEL).withColumn(
        "eta", F.coalesce("eta", F.lit(0.0)) + F.col("effect") * F.col("treatment"))
    other = known.select(*MODEL, "stratum_id", (1 - F.col("treatment")).alias("treatment"), F.col("eta").alias("other_eta"),
                         F.col("survival_time").alias("other_time"), F.col("event").alias("other_event"))
    both = known.join(other, entry)
    q = 1.0 / (1.0 + F.exp(F.col("eta") - F.col("other_eta")))
    mine, theirs = F.col("event") & (F.col("other_time") >= F.col("survival_time")), F.col("other_event") & (F.col("survival_time") >= F.col("other_time"))
    residual = both.select(*entry, (F.when(theirs, 1 - q).otherwise(0.0) - F.when(mine, q).otherwise(0.0)).alias("residual"), (mine | theirs).alias("told"))
    slopes = values.join(residual.filter("told"), entry).groupBy(*MODEL, "covariate_id").agg(
        F.sum(F.col("x") * F.col("residual")).alias("slope"), F.max(F.abs("x")).alias("largest"))
    treated = residual.groupBy(*MODEL).agg(F.sum(F.col("residual") * F.col("treatment")).alias("slope")).select(
        *MODEL, F.lit(TREATMENT).cast("long").alias("covariate_id"), "slope", F.lit(1.0).alias("largest"))
    sizes = pair_counts(matched).select(*MODEL, (F.col("n10") + F.col("n01")).alias("events"))
    told = slopes.filter("largest > 0").unionByName(treated).join(F.broadcast(sizes), MODEL).join(inside, [*MODEL, "covariate_id"], "left")
    penalty, slope = F.when(F.col("covariate_id") == TREATMENT, 0.0).otherwise(L1), F.col("slope") / F.col("largest")
    beta = F.coalesce("coefficient", F.lit(0.0))
    away = F.when(beta == 0, F.greatest(F.abs(slope) - penalty, F.lit(0.0))).otherwise(F.abs(slope + penalty * F.signum(beta)))
    broken = told.groupBy(*MODEL).agg(F.sum(F.when(away > 1e-5 * F.col("events"), 1).otherwise(0)).alias("broken_conditions"))
    return (sizes.join(fits.select(*MODEL, "converged"), MODEL).join(broken, MODEL, "left")
            .withColumn("broken_conditions", F.coalesce("broken_conditions", F.lit(0))))


@query("m3_m5_model_summary", f"SELECT {SUMMARY_SQL} FROM outcome_summary")
def summary(study):
    return six(outcome_summary(study), ESTIMATE)


VIEWS["control_entered"] = f"""
    SELECT target_id, comparator_id, CAST(o AS BIGINT) AS outcome_id,
           CASE WHEN cohort_definition_id = target_id THEN 1 ELSE 0 END AS treatment, subject_id
    FROM comparisons, (VALUES {", ".join(f"({o})" for o in design.CONTROLS)}) AS v(o), arms
    WHERE cohort_definition_id IN (target_id, comparator_id)"""
EVERYONE = " UNION ALL BY NAME ".join(
    f"""SELECT {MODEL_SQL}, treatment, subject_id, 0 AS step FROM {part}entered
        UNION ALL BY NAME SELECT {MODEL_SQL}, treatment, subject_id, CASE WHEN prior_outcome THEN 1 WHEN time_at_risk < 1 THEN 2 ELSE 3 END AS step
        FROM {part}windowed"""
    for part in ("", "control_")
)
#: Concept sets that decide the arms, and a variance in place of the search, which p6_propensity makes.
ARM_SETS, WHOLE = (20, 28, 35), StudySettings(propensity={"variance": PRIOR_VARIANCE})


@query(
    "m3_whole_study",
    f"""SELECT {MODEL_SQL}, treatment, count(*) AS entered, count(*) FILTER (last >= 1) AS in_one_arm,
               count(*) FILTER (last >= 2) AS no_earlier_outcome, count(*) FILTER (last >= 3) AS at_risk,
               true AS matched_evenly, true AS calibrated
        FROM (SELECT {MODEL_SQL}, treatment, subject_id, max(step) AS last FROM ({EVERYONE}) GROUP BY ALL) GROUP BY ALL""",
)
def whole_study(study):
    """From cohorts to calibrated estimates in one call, with its own covariates, scores and controls. SQL tells
    the attrition of every model and arm; that both arms of a match are equally large and not larger than the
    smaller one before; and that each complete estimate, the outcomes' included, has its calibrated p."""
    ids = design.items(study).filter(F.col("codeset_id").isin(*ARM_SETS)).select("concept_id")
    found = run_study(
        study.cdm, design.arms(study), outcome_rows(study), grid(study), design.control_ids(study),
        group_concepts(study), scores_by_name(study), ids, WHOLE,
    )
    steps = found.outcomes.attrition.unionByName(found.controls.attrition)
    left = steps.groupBy(*MODEL, "treatment").agg(
        *[F.sum(F.when(F.col("step") == i, F.col("subjects"))).alias(n)
          for i, n in enumerate(("entered", "in_one_arm", "no_earlier_outcome", "at_risk", "matched"))]
    )
    arm = F.col("treatment") == 1
    sides = left.groupBy(*MODEL).agg(
        F.max(F.when(arm, F.col("matched"))).alias("one"), F.max(F.when(~arm, F.col("matched"))).alias("other"),
        F.min("at_risk").alias("most"),
    )
    even = sides.select(*MODEL, ((F.col("one") == F.col("other")) & (F.col("one") <= F.col("most"))).alias("matched_evenly"))
    complete = S.complete_cases(S.stack_summaries(found.controls.summary, found.outcomes.summary)).select(*MODEL, F.lit(True).alias("told"))
    done = found.estimates.filter("calibrated_p BETWEEN calibrated_p_lb95ci AND calibrated_p_ub95ci AND calibrated_p BETWEEN 0 AND 1")
    return (
        left.drop("matched").join(even, MODEL).join(complete, MODEL, "left")
        .join(done.select(*MODEL, F.lit(True).alias("done")), MODEL, "left")
        .withColumn("calibrated", F.col("told").eqNullSafe(F.col("done"))).drop("told", "done")
    )


@query("m4_control_summary", f"SELECT {SUMMARY_SQL} FROM control_summary")
def controls(study):
    return six(control_summary(study), ESTIMATE)


@query(
    "m6_event_rates",
    f"""SELECT {MODEL_SQL}, round(events_treated / treated_days * 100 * 365, 6)
               AS event_rate_treated,
               round(events_comparator / comparator_days * 100 * 365, 6) AS event_rate_comparator
        FROM outcome_summary""",
)
def rates(study):
    names = ["event_rate_treated", "event_rate_comparator"]
    return six(S.event_rates(outcome_summary(study)), names).select(*MODEL, *names)


@query("m7_complete_cases", f"SELECT {SUMMARY_SQL} FROM total_summary")
def complete(study):
    stacked = S.stack_summaries(control_summary(study), outcome_summary(study))
    return six(S.complete_cases(stacked), ESTIMATE)


GRID = K.Grid()
VIEWS["control_estimates"] = f"""
    SELECT * FROM total_summary WHERE outcome_id IN ({", ".join(map(str, design.CONTROLS))})"""
VIEWS["grid_points"] = f"""
    SELECT target_id, comparator_id, i * {GRID.sigma_points} + j AS point,
           middle + half * (i * (2.0 / ({GRID.mu_points} - 1)) - 1.0) AS mu,
           exp(ln({GRID.sigma_low}) + j * (ln(high) - ln({GRID.sigma_low})) / ({GRID.sigma_points} - 1)) AS sigma
    FROM (SELECT target_id, comparator_id, avg(log_rr) AS middle,
                 {GRID.mu_reach} * sqrt((var_pop(log_rr) + avg(se_log_rr * se_log_rr) + {GRID.sigma_scale**2}) / count(*)) AS half,
                 greatest({GRID.sigma_high}, {GRID.sigma_reach} * stddev_pop(log_rr)) AS high
          FROM control_estimates GROUP BY target_id, comparator_id),
         range({GRID.mu_points}) a(i), range({GRID.sigma_points}) b(j)"""
VIEWS["posterior"] = f"""
    SELECT analysis_id, target_id, comparator_id, point, mu, sigma,
           weight / sum(weight) OVER (PARTITION BY target_id, comparator_id) AS weight
    FROM (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY target_id, comparator_id))
                    AS weight
          FROM (SELECT analysis_id, target_id, comparator_id, point, mu, sigma,
                       sum(-0.5 * ln(sigma * sigma + se_log_rr * se_log_rr)
                           - (log_rr - mu) * (log_rr - mu)
                             / (2 * (sigma * sigma + se_log_rr * se_log_rr)))
                           + ln(any_value(sigma))
                           - pow(any_value(sigma), 2) / (2 * {GRID.sigma_scale**2}) AS loglik
                FROM control_estimates JOIN grid_points USING (target_id, comparator_id) GROUP BY ALL))"""
VIEWS["null_model"] = """
    SELECT analysis_id, target_id, comparator_id, sum(weight * mu) AS null_mean,
           1 / sqrt(sum(weight / (sigma * sigma))) AS null_sd
    FROM posterior GROUP BY ALL"""


def p_sql(z):
    t = f"(1 / (1 + {NORMAL_CDF_P} * abs({z})))"
    poly = " + ".join(f"({b}) * pow({t}, {i})" for i, b in enumerate(NORMAL_CDF_B, start=1))
    return f"least(1.0, 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({poly}))"


VIEWS["calibrated"] = f"""
    SELECT t.*, med AS calibrated_p, lb AS calibrated_p_lb95ci, ub AS calibrated_p_ub95ci,
           n.null_mean, n.null_sd
    FROM total_summary t JOIN null_model n USING (analysis_id, target_id, comparator_id)
    JOIN (SELECT target_id, comparator_id, outcome_id, min(p) FILTER (reached >= 0.025) AS lb,
                 min(p) FILTER (reached >= 0.5) AS med, min(p) FILTER (reached >= 0.975) AS ub
          FROM (SELECT *, sum(weight) OVER (PARTITION BY {MODEL_SQL} ORDER BY p, point) AS reached
                FROM (SELECT {MODEL_SQL}, weight, point, {p_sql("z")} AS p
                      FROM (SELECT t.target_id, t.comparator_id, t.outcome_id, q.weight, q.point,
                                   (log_rr - mu) / sqrt(sigma * sigma + se_log_rr * se_log_rr)
                                       AS z
                            FROM total_summary t
                            JOIN posterior q USING (analysis_id, target_id, comparator_id))))
          GROUP BY ALL) USING ({MODEL_SQL})"""


@query(
    "m8_null_grid",
    f"""SELECT analysis_id, target_id, comparator_id, {six_sql(["null_mean", "null_sd"])}
        FROM null_model""",
)
def null_grid(study):
    return six(K.null_distribution(posterior(study)), ["null_mean", "null_sd"])


CALIBRATED = ["calibrated_p", "calibrated_p_lb95ci", "calibrated_p_ub95ci", "null_mean", "null_sd"]


@query(
    "m9_calibrated_p",
    f"SELECT analysis_id, {MODEL_SQL}, {six_sql(CALIBRATED)} FROM calibrated",
)
def calibrated(study):
    out = K.calibrate(total_summary(study), posterior(study))
    return six(out.select("analysis_id", *MODEL, *CALIBRATED), CALIBRATED)


@query(
    "m10_effect_plot",
    f"""SELECT analysis_id, target_id, comparator_id,
               CASE WHEN outcome_id IN ({", ".join(map(str, design.CONTROLS))})
                    THEN 'negative' ELSE 'positive' END AS series,
               round(exp(log_rr), 6) AS rr, round(se_log_rr, 6) AS se
        FROM total_summary
        UNION ALL
        SELECT analysis_id, target_id, comparator_id, series,
               round(exp(null_mean + side * 1.959964 * sqrt(null_sd * null_sd
                     + pow(i * 0.04, 2))), 6), round(i * 0.04, 6)
        FROM null_model, range(1, 51) r(i),
             (VALUES ('boundary_low', -1), ('boundary_high', 1)) v(series, side)""",
)
def plot(study):
    ids = study.spark.createDataFrame([(c,) for c in design.CONTROLS], "concept_id long")
    null = K.null_distribution(posterior(study))
    return six(K.effect_plot(total_summary(study), null, ids), ["rr", "se"])


@query(
    "m11_stack_summaries",
    f"""SELECT {MODEL_SQL}, treated, calibrated_p FROM (
            SELECT {MODEL_SQL}, treated, CAST(NULL AS DOUBLE) AS calibrated_p FROM outcome_summary
            UNION ALL SELECT {MODEL_SQL}, treated, round(calibrated_p, 6) FROM calibrated)""",
)
def stacked(study):
    with_p = K.calibrate(total_summary(study), posterior(study))
    out = S.stack_summaries(outcome_summary(study), with_p)
    return out.select(*MODEL, "treated", F.round("calibrated_p", 6).alias("calibrated_p"))


@query(
    "m12_subgroups",
    f"""SELECT '1, gender, ' || CASE WHEN female THEN 'female' ELSE 'male' END AS analysis_id,
               {MODEL_SQL}, count(*) FILTER (treatment = 1) AS treated,
               count(*) FILTER (treatment = 0) AS comparator,
               count(*) FILTER (outcome_count > 0) AS events
        FROM (SELECT m.*, p.gender_concept_id = 8532 AS female
              FROM population m JOIN person p ON p.person_id = m.subject_id)
        GROUP BY ALL
        UNION ALL
        SELECT '1', {MODEL_SQL}, count(*) FILTER (treatment = 1),
               count(*) FILTER (treatment = 0), count(*) FILTER (outcome_count > 0)
        FROM population GROUP BY ALL""",
)
def subgroups(study):
    from checks.study_queries import population

    who = study.cdm["person"].select(F.col("person_id").alias("subject_id"), "gender_concept_id")
    rows = population(study).join(who, "subject_id")
    status = F.when(F.col("gender_concept_id") == 8532, "female").otherwise("male")
    split = S.arm_totals(rows.withColumn("status", status), ["status", *MODEL])
    parts = [
        S.label_subgroup(
            split.filter(F.col("status") == s).withColumn("analysis_id", F.lit("1")), "gender", s
        ).drop("status")
        for s in ("female", "male")
    ]
    whole = S.arm_totals(rows).withColumn("analysis_id", F.lit("1"))
    total = S.stack_summaries(*parts, whole)
    return total.select(
        "analysis_id",
        *MODEL,
        "treated",
        "comparator",
        (F.col("events_treated") + F.col("events_comparator")).alias("events"),
    )


def cohort_names(study):
    raw = study.spark.createDataFrame(list(NAMES), "cohort_id long, raw string")
    return raw.select("cohort_id", display_name(F.col("raw")).alias("name"))


NAME_SQL = " ".join(f"WHEN {i} THEN '{n}'" for i, n in NAMES)
SHOW_SQL = "replace(regexp_replace(replace({x}, ' ', '_'), '\\[(.*?)\\]_', '', 'g'), '_', ' ')"


@query(
    "m13_named_summary",
    f"""SELECT {SHOW_SQL.format(x=f"CASE target_id {NAME_SQL} END")} AS target_id,
               {SHOW_SQL.format(x=f"CASE comparator_id {NAME_SQL} END")} AS comparator_id,
               outcome_id, treated FROM outcome_summary""",
)
def named(study):
    out = S.name_cohorts(outcome_summary(study), cohort_names(study))
    return out.select("target_id", "comparator_id", "outcome_id", "treated")


@query(
    "e3_cohort_names",
    f"""SELECT cohort_definition_id, {SHOW_SQL.format(x="raw")} AS display,
               lower(regexp_replace(replace(raw, ' ', '_'), '\\[(.*?)\\]_', '', 'g')) AS file_name,
               entries
        FROM (SELECT cohort_definition_id, CASE cohort_definition_id {NAME_SQL} END AS raw,
                     count(*) AS entries FROM arms GROUP BY ALL)""",
)
def names_query(study):
    raw = study.spark.createDataFrame(list(NAMES), "cohort_definition_id long, raw string")
    counted = design.arms(study).groupBy("cohort_definition_id").agg(
        F.count("*").alias("entries")
    )
    return counted.join(raw, "cohort_definition_id").select(
        "cohort_definition_id",
        display_name(F.col("raw")).alias("display"),
        underscored_name(F.col("raw"), lower=True).alias("file_name"),
        "entries",
    )


FOREST = ["hr", "hr_lb95ci", "hr_ub95ci"]


@query(
    "m14_forest",
    f"""SELECT analysis_id, {MODEL_SQL}, round(exp(log_rr), 6) AS hr,
               round(exp(log_rr - 1.96 * se_log_rr), 6) AS hr_lb95ci,
               round(exp(log_rr + 1.96 * se_log_rr), 6) AS hr_ub95ci
        FROM outcome_summary""",
)
def forest(study):
    return six(S.forest_data(outcome_summary(study)), FOREST)
