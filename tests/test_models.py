import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinarm.functions.mathx import two_sided_p
from twinarm.functions.names import display_name, underscored_name
from twinarm.operators import calibration as K
from twinarm.operators import cox as X
from twinarm.operators import summary as S
from twinarm.operators import survival as R
from twinarm.operators import table1 as T
from twinarm.operators.cox import TREATMENT, cox, cox_grid, cox_pairs, packed_strata
from twinarm.operators.cox import _adder as cox_adder
from twinarm.operators.cox import _Strata, penalized_step
from twinarm.operators.logistic import SUMS

POP = "target_id long, comparator_id long, outcome_id long, treatment int, subject_id long, " \
    "cohort_start_date date, stratum_id string, survival_time int, outcome_count long, time_at_risk int"


def pairs(frame, n, seed=1, model=(1, 2, 9)):
    rng = np.random.default_rng(seed)
    rows, x = [], {}
    for i in range(n):
        for arm in (0, 1):
            subject = 2 * i + arm
            x[subject] = int(rng.random() < 0.5)
            rate = 0.02 * math.exp(0.6 * arm + 0.9 * x[subject])
            t, stop = int(rng.exponential(1 / rate)) + 1, int(rng.integers(10, 60))
            rows.append((*model, arm, subject, "2000-01-01", str(i), min(t, stop), int(t <= stop), stop))
    return rows, x


def test_pairs_closed_form_matches_the_iterative_fit(frame):
    rows = pairs(frame, 150)[0] + pairs(frame, 80, 4, (3, 2, 9))[0]
    matched = frame(rows, POP)
    closed = {r.target_id: r for r in cox_pairs(matched).collect()}
    fitted = {r.target_id: r for r in cox_grid(matched, tolerance=1e-10).collect()}
    for target in (1, 3):
        assert fitted[target].log_rr == pytest.approx(closed[target].log_rr, abs=1e-3)
        assert fitted[target].se_log_rr == pytest.approx(closed[target].se_log_rr, abs=1e-3)


def test_only_treated_events_give_null(frame):
    matched = frame(
        [(1, 2, 9, 1, 1, "2000-01-01", "a", 5, 1, 9), (1, 2, 9, 0, 2, "2000-01-01", "a", 9, 0, 9)], POP
    )
    assert cox_pairs(matched).first().log_rr is None
    row = cox_grid(matched).first()
    assert row.log_rr is None and row.se_log_rr is None and not row.converged


def test_an_unconverged_fit_says_so(frame):
    row = cox_grid(frame(pairs(frame, 60)[0], POP), max_iter=1, tolerance=1e-14).first()
    assert not row.converged and row.iterations == 2 and row.log_rr is None


def test_partner_censored_before_event_and_tied_events(frame):
    matched = frame(
        [
            (1, 2, 9, 1, 1, "2000-01-01", "a", 5, 1, 9), (1, 2, 9, 0, 2, "2000-01-01", "a", 3, 0, 3),
            (1, 2, 9, 1, 3, "2000-01-01", "b", 5, 1, 9), (1, 2, 9, 0, 4, "2000-01-01", "b", 5, 1, 9),
        ],
        POP,
    )
    row = cox_pairs(matched).first()
    assert row.log_rr == pytest.approx(0.0) and row.se_log_rr == pytest.approx(math.sqrt(2))


def sets(n, covariates, seed=1, model=(1, 2, 9), most=4):
    """Matched sets of one treated and up to ``most`` others, with covariates that go with treatment."""
    rng = np.random.default_rng(seed)
    rows, x = [], {}
    for i in range(n):
        for arm in [1] + [0] * int(rng.integers(1, most + 1)):
            subject = len(x)
            x[subject] = [float(rng.random() < 0.3 + 0.4 * arm), *np.round(rng.normal(0, 1, covariates - 1), 3).tolist()]
            rate = 0.02 * math.exp(0.5 * arm + 0.8 * x[subject][0] - 0.3 * x[subject][-1])
            t, stop = int(rng.exponential(1 / rate)) + 1, int(rng.integers(8, 60))
            rows.append((*model, arm, subject, "2000-01-01", str(i), min(t, stop), int(t <= stop), stop))
    values = [(model[0] if r[3] else model[1], r[4], "2000-01-01", 70 + k, v)
              for r in rows for k, v in enumerate(x[r[4]]) if v]
    return rows, np.array([[r[3], *x[r[4]]] for r in rows]), values


COVARIATES = "cohort_definition_id long, subject_id long, cohort_start_date date, covariate_id long, covariate_value double"


def dense_loss(rows, x, beta):
    """Negative log partial likelihood, row by row."""
    eta = x @ beta
    strata = {}
    for i, r in enumerate(rows):
        strata.setdefault(r[6], []).append(i)
    loss = 0.0
    for members in strata.values():
        for i in members:
            if rows[i][8]:
                loss -= eta[i] - math.log(sum(math.exp(eta[j]) for j in members if rows[j][7] >= rows[i][7]))
    return loss


def dense_derivatives(rows, x, beta, step=1e-4):
    unit = np.eye(len(beta)) * step
    loss = lambda b: dense_loss(rows, x, b)
    gradient = np.array([(loss(beta + u) - loss(beta - u)) / (2 * step) for u in unit])
    hessian = np.array([[(loss(beta + u + v) - loss(beta + u - v) - loss(beta - u + v) + loss(beta - u - v)) / (4 * step**2)
                         for v in unit] for u in unit])
    return gradient, hessian


@pytest.mark.parametrize("l1", [0.0, 1.5, 6.0])
def test_cox_with_covariates_meets_conditions_and_its_error_the_numeric_hessian(frame, l1):
    rows, x, values = sets(70, 4)
    (fit,) = cox(frame(rows, POP), frame(values, COVARIATES), l1=l1, tolerance=1e-9).values()
    assert fit.converged and fit.iterations > 1
    beta = np.array([fit.beta.get(TREATMENT)] + [fit.beta.get(70 + k, 0.0) for k in range(4)])
    gradient, hessian = dense_derivatives(rows, x, beta)
    # The penalty is on values divided by the largest of their covariate.
    scale = np.array([1.0, *np.abs(x[:, 1:]).max(axis=0)])
    assert abs(gradient[0]) < 1e-5
    for k in range(1, 5):
        slope = gradient[k] / scale[k]
        assert slope == pytest.approx(-l1 * np.sign(beta[k]), abs=1e-4) if beta[k] else abs(slope) <= l1 + 1e-4
    on = [0, *[k for k in range(1, 5) if beta[k]]]
    assert len(on) == {0.0: 5, 6.0: 2}.get(l1, len(on))
    error = math.sqrt(np.linalg.inv(hessian[np.ix_(on, on)])[0, 0])
    assert fit.se == pytest.approx(error, rel=1e-4)
    if len(on) > 1:  # a covariate that goes with treatment widens the error
        assert fit.se > 1.02 / math.sqrt(hessian[0, 0])


def test_models_with_and_without_information_are_fitted_together(frame):
    one, x, values = sets(50, 3, 5)
    other, y, more = sets(40, 3, 6, (3, 2, 9), 1)
    other = [(*r[:4], r[4] + 1000, *r[5:]) for r in other]
    more = [(r[0], r[1] + 1000, *r[2:]) for r in more]
    idle = [(4, 2, 9, 1, 5001, "2000-01-01", "q", 9, 0, 9), (4, 2, 9, 0, 5002, "2000-01-01", "q", 9, 0, 9)]
    found = cox(frame(one + other + idle, POP), frame(values + more, COVARIATES), l1=0.5, tolerance=1e-9)
    assert set(found) == {(1, 2, 9), (3, 2, 9), (4, 2, 9)}
    assert found[4, 2, 9].se is None and not found[4, 2, 9].beta
    for rows, values, model in ((one, values, (1, 2, 9)), (other, more, (3, 2, 9))):
        (alone,) = cox(frame(rows, POP), frame(values, COVARIATES), l1=0.5, tolerance=1e-9).values()
        assert found[model].se == pytest.approx(alone.se, rel=1e-6)
        assert found[model].beta == pytest.approx(alone.beta, rel=1e-4, abs=1e-7)


def test_a_covariate_that_is_treatment_leaves_no_error(frame):
    rows, _, _ = sets(40, 1, 8)
    same = [(1, r[4], "2000-01-01", 5, 1.0) for r in rows if r[3]]
    (fit,) = cox(frame(rows, POP), frame(same, COVARIATES), l1=0.0).values()
    assert fit.se is None or 5 not in fit.beta


def test_only_strata_that_tell_something_are_packed(frame):
    rows, _, _ = sets(60, 2, 9)
    packed, _, _ = packed_strata(frame(rows, POP), None)
    want = {}
    for r in rows:
        want.setdefault(r[6], []).append(r)
    for k, members in list(want.items()):
        first = min((r[7] for r in members if r[8]), default=None)
        kept = [r for r in members if first is not None and r[7] >= first]
        if len(kept) < 2:
            del want[k]
        else:
            want[k] = sorted(r[7] for r in kept)
    assert sorted(sorted(r.time) for r in packed.collect()) == sorted(want.values())


def test_an_iteration_shuffles_nothing_but_its_sums(frame):
    """The rows of a pass are read, turned into sums in one task, and only sums are exchanged."""
    rows, _, values = sets(30, 3, 2)
    strata, _, positions = packed_strata(frame(rows, POP), frame(values, COVARIATES))
    width = positions.count() + 1
    shared = strata.sparkSession.sparkContext.broadcast({1: (np.zeros((width, 1)), None, False)})
    sums = strata.mapInArrow(cox_adder(shared), SUMS).repartition("model", "block")
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sums.count() <= 2 * strata.rdd.getNumPartitions()


def test_p_values_and_names(frame):
    df = frame([(0.0,), (1.959964,), (-2.575829,)], "z double")
    got = [r[0] for r in df.select(two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([1.0, 0.05, 0.01], abs=1e-6)
    names = frame([("[Tag-1] Arm with device",)], "n string")
    assert names.select(display_name(F.col("n"))).first()[0] == "Arm with device"
    assert names.select(underscored_name(F.col("n"), True)).first()[0] == "arm_with_device"


SUMMARY = "analysis_id string, target_id long, comparator_id long, outcome_id long, log_rr double, " \
    "se_log_rr double"


def test_calibration_moves_p_towards_the_controls(frame):
    rng = np.random.default_rng(0)
    controls = [("1", 1, 2, 100 + i, float(rng.normal(0.4, 0.1)), 0.1) for i in range(40)]
    summary = frame([*controls, ("1", 1, 2, 9, 0.4, 0.1), ("1", 1, 2, 10, 1.5, 0.1)], SUMMARY)
    post = K.null_posterior(frame(controls, SUMMARY))
    null = K.null_distribution(post).first()
    assert null.null_mean == pytest.approx(0.4, abs=0.08) and null.null_sd < 0.2
    out = {r.outcome_id: r for r in K.calibrate(summary, post).collect()}
    assert out[9].calibrated_p > 0.7 and out[10].calibrated_p < 0.001
    for r in out.values():
        assert 0 <= r.calibrated_p_lb95ci <= r.calibrated_p_ub95ci <= 1


def test_calibration_hardly_moves_with_the_ends_of_the_grid(frame):
    rng = np.random.default_rng(5)
    controls = [("1", 1, 2, 100 + i, float(rng.normal(0.1, 0.2) + rng.normal(0, 0.3)), 0.3) for i in range(30)]
    summary = frame([*controls, ("1", 1, 2, 9, 0.7, 0.3)], SUMMARY)
    got = []
    for low in (0.001, 0.01, 0.03):
        grid = K.Grid(sigma_low=low)
        out = K.calibrate(summary, K.null_posterior(frame(controls, SUMMARY), grid), grid)
        row = out.filter("outcome_id = 9").first()
        assert row.calibrated_p_lb95ci <= row.calibrated_p <= row.calibrated_p_ub95ci
        got.append(row.calibrated_p)
    assert max(got) - min(got) < 0.01


def test_a_comparison_far_from_zero_has_its_own_grid(frame):
    rng = np.random.default_rng(3)
    errors = rng.normal(0, 0.2, 25)
    near = [("1", 1, 2, 100 + i, float(e), 0.1) for i, e in enumerate(errors)]
    far = [("1", 3, 2, 100 + i, float(4 + e), 0.1) for i, e in enumerate(errors)]
    post = K.null_posterior(frame(near + far, SUMMARY))
    null = {r.target_id: r for r in K.null_distribution(post).collect()}
    assert null[3].null_mean == pytest.approx(4 + null[1].null_mean, abs=1e-6)
    assert null[3].null_sd == pytest.approx(null[1].null_sd, abs=1e-6) and 0.1 < null[3].null_sd < 0.3
    wide = [("1", 5, 2, 100 + i, float(30 * e), 0.1) for i, e in enumerate(errors)]
    assert K.null_distribution(K.null_posterior(frame(wide, SUMMARY))).first().null_sd > 1
    few = [("1", 6, 2, 100 + i, 0.1 * i, 0.05) for i in range(2)]
    assert K.null_distribution(K.null_posterior(frame(few, SUMMARY))).count() == 1


@pytest.mark.parametrize("column", ["null_mean", "null_sd"])
def test_a_grid_that_is_too_narrow_fails(frame, column):
    controls = [("1", 1, 2, 100 + i, 0.1 * i, 0.1) for i in range(5)]
    grid = K.Grid(mu_reach=0.01)
    post = K.null_posterior(frame(controls, SUMMARY), grid)
    with pytest.raises(Exception, match="edge of the grid"):
        K.null_distribution(post, grid).select(column).collect()


def test_complete_cases_and_rates(frame):
    summary = frame([("1", 1, 2, 9, 0.5, 0.1), ("1", 1, 2, 10, None, 0.1), ("1", 1, 2, 11, float("nan"), 0.1),
                     ("1", 1, 2, 12, 0.1, float("inf"))], SUMMARY)
    assert [r.outcome_id for r in S.complete_cases(summary).collect()] == [9]
    rates = frame([(2, 0, 730, 0)], "events_treated int, events_comparator int, treated_days int, comparator_days int")
    row = S.event_rates(rates).first()
    assert row.event_rate_treated == pytest.approx(100.0) and row.event_rate_comparator is None


def test_kaplan_meier(frame):
    base = (1, 2, 9)
    rows = [(*base, 1, i, "2000-01-01", "", 5, 1, 5) for i in range(3)]
    rows += [(*base, 0, 10, "2000-01-01", "", 3, 1, 9), (*base, 0, 11, "2000-01-01", "", 3, 0, 3),
             (*base, 0, 12, "2000-01-01", "", 7, 1, 9)]
    got = {(r.treatment, r.day): (r.at_risk, r.survival) for r in R.kaplan_meier(frame(rows, POP)).collect()}
    assert got[(1, 5)] == (3, 0.0)
    assert got[(0, 3)][0] == 3 and got[(0, 3)][1] == pytest.approx(2 / 3)
    assert got[(0, 7)] == (1, 0.0)
    median = R.median_time_at_risk(frame(rows, POP)).first()
    assert (median.t_median_days, median.c_median_days) == (5.0, 9.0)


def test_table1_signs_empty_arm_and_constant_score(frame):
    rows = frame([(1, 3.0, 1), (1, 5.0, 0), (0, 1.0, 1), (0, 1.0, 1)], "treatment int, score double, after_match int")
    mean = T.continuous_block(rows, []).filter("line = 1").first()
    assert mean.t_before_n == 4.0 and mean.before_std_diff == pytest.approx(3.0)
    assert mean.after_std_diff is None  # one treated value: its sd is unknown
    bands = frame([(1, "a", 1), (1, "a", 1), (1, "b", 0), (0, "b", 1)], "treatment int, category string, after_match int")
    got = {r.category: r for r in T.categorical_block(bands.withColumn("g", F.lit(1)), ["g"]).collect()}
    # Two of three targets and no comparator: comparator minus target is negative.
    assert got["a"].before_std_diff == pytest.approx(round(-(2 / 3) / math.sqrt(1 / 3), 3))
    only = frame([(1, 1, 1)], "treatment int, score int, after_match int")
    line = T.count_block(only, []).first()
    assert line.t_before_pct == 100.0 and line.c_before_pct is None


def test_strata_whose_subjects_differ_beyond_an_exponential():
    """The subject with the later event lags the other by 2000 on the log scale: its risk set is itself."""
    batch = pa.RecordBatch.from_pydict({
        "time": [[9, 5]], "event": [[1, 1]], "treatment": [[0, 1]], "widths": [[1, 1]],
        "positions": [[1, 2]], "values": [[1.0, 1.0]],
    })
    strata = _Strata(batch)
    strata.evaluate(np.array([0.0, -1000.0, 1000.0]))
    assert strata.loss == pytest.approx(0.0) and np.allclose(strata.residual, 0.0) and strata.told() == (1.0, 0.0)
    assert np.allclose(strata.information(np.array([0, 1, 2])), 0.0)
    strata.evaluate(np.array([0.0, 1000.0, -1000.0]))
    assert strata.loss == pytest.approx(2000.0) and np.allclose(strata.residual, [[1.0, -1.0]])


def test_penalized_step_goes_downhill_where_covariates_repeat():
    """More covariates than rows, three of them alike: the step meets the conditions of its own problem."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 30))
    x[:, 8] = x[:, 9] = x[:, 7]
    matrix, beta = x.T @ x, np.where(rng.random(30) < 0.4, rng.normal(size=30), 0.0)
    slope = x.T @ rng.normal(size=12) * 3
    step = penalized_step(matrix, slope, beta, 0.8)
    weight = np.array([0.0] + [0.8] * 29)
    to, own = beta + step, slope + matrix @ step
    away = np.where(to != 0, np.abs(own + weight * np.sign(to)), np.maximum(np.abs(own) - weight, 0))
    assert away.max() < 1e-3 and np.abs(step).max() < 100
    assert slope @ step + step @ own / 2 - slope @ step / 2 + weight @ np.abs(to) < weight @ np.abs(beta)


def test_newton_steps_share_matrices_and_end_with_their_own(frame, monkeypatch):
    """Most passes sum no information matrix; the last one does, for the standard error."""
    rng = random.Random(11)
    rows, cov = [], []
    for pair in range(120):
        for arm in (0, 1):
            subject = 1000 * arm + pair
            xs = [c for c in range(12) if rng.random() < 0.2 + 0.05 * c]
            time = 1 + int(rng.expovariate(0.02 * (1.6 if arm else 1.0) * (1 + 0.8 * (3 in xs) + 0.5 * (7 in xs))))
            rows.append((1, 2, 3, arm, subject, "2000-01-01", str(pair), time, 1))
            cov += [(1 if arm else 2, subject, "2000-01-01", 50 + c, 1.0) for c in xs]
    data = frame(rows, "target_id long, comparator_id long, outcome_id long, treatment int, subject_id long, cohort_start_date date, "
                       "stratum_id string, survival_time int, outcome_count int")
    covariates = frame(cov, "cohort_definition_id long, subject_id long, cohort_start_date date, covariate_id long, covariate_value double")
    seen, summed = [], X.L.summed
    monkeypatch.setattr(X.L, "summed", lambda r, adder, state: seen.append(isinstance(state[1][2], np.ndarray)) or summed(r, adder, state))
    monkeypatch.setattr(X, "NEAR", 10.0)
    shared = X.cox(data, covariates, l1=0.3)[1, 2, 3]
    asked = [i for i, s in enumerate(seen) if s]
    assert seen[-1] and len(asked) < len(seen) - asked[0]
    monkeypatch.setattr(X, "REFRESH", 0)  # a matrix for each step, as before
    own = X.cox(data, covariates, l1=0.3)[1, 2, 3]
    assert shared.converged and own.converged and shared.se == pytest.approx(own.se, rel=1e-5)
    assert all(shared.beta.get(k, 0.0) == pytest.approx(own.beta.get(k, 0.0), abs=1e-4) for k in shared.beta | own.beta)
