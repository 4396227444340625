import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinarm.operators import balance as B
from twinarm.operators import matching as M
from twinarm.operators import population as P
from twinarm.operators import propensity as PS

COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
SCORED = "m int, treatment int, subject_id long, cohort_start_date date, ps double"
GRID = "target_id long, comparator_id long, outcome_id long"


def test_time_at_risk_and_prior_outcome(frame):
    cohorts = frame(
        [
            (1, 1, "2000-01-10", "2000-02-10"),
            (1, 2, "2000-01-10", "2000-02-10"),  # outcome on the index day
            (1, 3, "2000-02-10", "2000-02-10"),  # no day at risk
            (2, 4, "2000-01-10", "2000-02-10"),  # event on the last day
            (1, 5, "2000-01-10", "2000-02-10"), (2, 5, "2000-01-12", "2000-02-10"),  # in both arms
        ],
        COHORT,
    )
    periods = frame(
        [(p, "1999-01-01", "2000-02-10") for p in range(1, 6)],
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    )
    outcomes = frame(
        [(9, 1, "2000-01-15", "2000-01-16"), (9, 1, "2000-01-20", "2000-01-21"),
         (9, 2, "2000-01-10", "2000-01-11"), (9, 4, "2000-02-10", "2000-02-11")],
        COHORT,
    )
    grid = frame([(1, 2, 9)], GRID)
    pairs = P.exposure_pairs(cohorts, grid, periods)
    got = {r.subject_id: r for r in P.study_population(pairs, grid, outcomes).collect()}
    assert set(got) == {1, 4}
    assert (got[1].time_at_risk, got[1].outcome_count, got[1].survival_time) == (31, 2, 5)
    assert (got[4].days_to_event, got[4].survival_time) == (30, 31)
    both = P.exposure_pairs(cohorts, grid, periods, remove_duplicate_subjects=False)
    assert both.filter("subject_id = 5").count() == 2


def greedy(rows, width):
    """Sequential greedy by (distance, mix, scores); rows of a score pair by id."""
    pools = {0: {}, 1: {}}
    for arm, subject, k in rows:
        pools[arm].setdefault(k, []).append(subject)
    for arm in pools:
        for k in pools[arm]:
            pools[arm][k].sort()
    order = sorted(
        (abs(t - c), (t * M.MIX_T + c * M.MIX_C) % M.MIX_MOD if t != c else -1, t, c)
        for t in pools[1] for c in pools[0] if abs(t - c) <= width
    )
    pairs = set()
    for _, _, t, c in order:
        while pools[1][t] and pools[0][c]:
            pairs.add((pools[1][t].pop(0), pools[0][c].pop(0)))
    return pairs


@pytest.mark.parametrize("per_bucket", [200_000, 4])
def test_matching_equals_sequential_greedy(spark, frame, monkeypatch, per_bucket):
    monkeypatch.setattr(M, "GROUPS_PER_BUCKET", per_bucket)
    rng = random.Random(per_bucket)
    rows, cases = [], {}
    for m in range(30):
        n = rng.randint(2, 40)
        digits = rng.choice([1, 2, 9])
        case = []
        for i in range(n):
            ps = round(rng.uniform(0.1, 0.9), digits)
            if m % 5 == 0 and i % 3 == 0:
                ps = 0.5  # one score holds a third of the rows
            arm = int(rng.random() < 0.45)
            case.append((arm, m * 1000 + i, round(ps * M.SCORE_UNIT)))
            rows.append((m, arm, m * 1000 + i, "2000-01-01", ps))
        cases[m] = case
    data = frame(rows, SCORED)
    caliper = 0.08
    got = M.match(data, ["m"], caliper, "propensity score").collect()
    for m, case in cases.items():
        mine = [r for r in got if r.m == m]
        strata = {}
        for r in mine:
            strata.setdefault(r.stratum_id, {})[r.treatment] = r.subject_id
        assert all(set(s) == {0, 1} for s in strata.values())
        assert len({r.subject_id for r in mine}) == len(mine)
        want = greedy(case, math.floor(caliper * M.SCORE_UNIT))
        assert {(s[1], s[0]) for s in strata.values()} == want


def test_one_hot_score_takes_its_partners_in_few_rounds(spark, frame, monkeypatch):
    """Many treated on one score, comparators on scores of their own inside the caliper."""
    n, rounds = 2000, []
    monkeypatch.setattr(M, "_round", lambda state, keys, f=M._round: rounds.append(1) or f(state, keys))
    case = [(1, i, M.SCORE_UNIT // 2) for i in range(n)]
    case += [(0, n + i, M.SCORE_UNIT // 2 + (1 if i % 2 else -1) * 1000 * (i + 1)) for i in range(n)]
    data = frame([(1, a, i, "2000-01-01", k / M.SCORE_UNIT) for a, i, k in case], SCORED)
    got = M.match(data, ["m"], 0.1, "propensity score").collect()
    strata = {}
    for r in got:
        strata.setdefault(r.stratum_id, {})[r.treatment] = r.subject_id
    assert {(s[1], s[0]) for s in strata.values()} == greedy(case, M.SCORE_UNIT // 10)
    assert len(strata) == n and len(rounds) <= 5


def test_matching_ratio_and_strata(frame):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), int(rng.random() < 0.25), i, "2000-01-01", round(rng.random(), 3), rng.randint(0, 1))
            for i in range(400)]
    data = frame(rows, SCORED + ", s int")
    got = M.match(data, ["m"], 0.2, max_ratio=3, strata=("s",)).collect()
    assert len({r.subject_id for r in got}) == len(got)
    strata = {}
    for r in got:
        strata.setdefault((r.m, r.s, r.stratum_id), []).append(r)
    sizes = set()
    for members in strata.values():
        treated = [r for r in members if r.treatment == 1]
        assert len(treated) == 1 and 2 <= len(members) <= 4
        sizes.add(len(members))
    assert max(sizes) == 4
    one = M.match(data, ["m"], 0.2, strata=("s",))
    assert one.filter("treatment = 1").count() == len(strata)


def test_matching_plans_do_not_grow_with_the_rounds(frame, monkeypatch):
    """Ever smaller gaps take a round per link; the size that Spark assumes for what is left must not multiply."""
    at, groups = 0, []
    for i in range(16):
        groups.append((1, i % 2, at, 1, 10**9))
        at += 1000 - 20 * i
    assumed, plain = [], M._round

    def seen(state, keys):
        assumed.append(state._jdf.queryExecution().optimizedPlan().stats().simpleString())
        return plain(state, keys)

    monkeypatch.setattr(M, "_round", seen)
    pairs = M.match_groups(frame(groups, "m int, treatment int, score long, size long, width long"), ["m"])
    assert pairs.count() == 8 and len(assumed) > 6
    assert all(re.match(r"sizeInBytes=[0-9.]+ (B|KiB)\b", s) for s in assumed)


def test_empty_arm_matches_nothing(frame):
    data = frame([(1, 1, i, "2000-01-01", 0.5) for i in range(4)], SCORED)
    assert M.match(data, ["m"]).isEmpty()


def model_rows(frame, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)) < 0.5
    treated = rng.random(n) < 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.8 * x[:, 1])))
    pop = frame(
        [(1, 2, 9, int(t), i, "2000-01-01") for i, t in enumerate(treated)],
        "target_id long, comparator_id long, outcome_id long, treatment int, subject_id long, "
        "cohort_start_date date",
    )
    cov = frame(
        [(1 if treated[i] else 2, i, "2000-01-01", j + 1, 1.0) for i in range(n) for j in range(3) if x[i, j]],
        "cohort_definition_id long, subject_id long, cohort_start_date date, covariate_id long, "
        "covariate_value double",
    )
    return x, treated, pop, cov


def test_propensity_recovers_the_model(frame):
    x, treated, pop, cov = model_rows(frame, 600)
    # A second model with the arms of the first swapped, fitted in the same passes.
    other = pop.withColumn("target_id", F.lit(2).cast("long")).withColumn("comparator_id", F.lit(1).cast("long")).withColumn(
        "treatment", 1 - F.col("treatment"))
    scored, fits, coefficients = PS.propensity_fits(pop.unionByName(other), cov, folds=3, repetitions=2, tolerance=1e-5)
    rows = scored.filter("target_id = 1").collect()
    ps = np.zeros(len(treated))
    for r in rows:
        ps[r.subject_id] = r.ps
    assert len(rows) == len(treated) and ps[x[:, 0] & ~x[:, 1]].mean() > 0.65 > 0.45 > ps[~x[:, 0] & x[:, 1]].mean()
    assert abs(ps.mean() - treated.mean()) < 1e-4
    mirrored = {r.subject_id: r.ps for r in scored.filter("target_id = 2").collect()}
    assert all(abs(mirrored[i] + ps[i] - 1) < 1e-2 for i in range(len(treated)))
    fit = fits.filter("target_id = 1").first()
    assert fit.converged and fit.violation <= 1e-5 and fit.variance > 0.01
    beta = {r.covariate_id: r.coefficient for r in coefficients.filter("target_id = 1").collect()}
    eta = beta[0] + x @ np.array([beta.get(j + 1, 0.0) for j in range(3)])
    assert np.allclose(1 / (1 + np.exp(-eta)), ps)
    # The optimum of the penalised likelihood, by its conditions.
    penalty = math.sqrt(2 / fit.variance)
    for j in range(3):
        slope = (x[:, j] * (ps - treated)).sum()
        assert abs(slope) <= penalty + 0.01 and (j + 1 not in beta or abs(slope + penalty * np.sign(beta[j + 1])) < 0.01)


def test_search_ends_at_the_best_of_its_neighbours(frame):
    """Found variances are at least as good as those a quarter of a decade away, tried one by one."""
    _, _, pop, cov = model_rows(frame, 200, 7)
    rows, positions = PS.packed_rows(pop, cov, 1, 4, 2)
    squares = PS.scaled_squares(positions)
    sizes = {1: (len(squares[1]), 200, pop.agg(F.avg("treatment")).first()[0])}
    found, losses, _ = PS.search_variance(rows, sizes, squares, 0.01, 4, 2, 1000, 2e-4)
    r, f = np.repeat([0, 1], 4), np.tile(np.arange(4), 2)

    def loss(variance):
        problems = {1: PS.L.Problems(np.full(8, math.sqrt(2 / variance)), r, f)}
        return PS.L.held_out_loss(rows, PS.L.fit(rows, sizes, squares, problems, 1000, 2e-4), problems)[1].sum()

    best = loss(found[1])
    assert best == pytest.approx(losses[1][found[1]], rel=1e-3) and min(losses[1].values()) == losses[1][found[1]]
    assert 0.01 in losses[1] and len(losses[1]) >= 7
    for near in (found[1] * 10**0.25, found[1] / 10**0.25):
        assert loss(near) >= best - 1e-3 * abs(best)


def test_descent_among_a_few_covariates_ends_where_all_would(frame):
    """Covariates that begin outside the working set come in once their slope exceeds the penalty."""
    rng = np.random.default_rng(11)
    x = (rng.random((250, 30)) < 0.3).astype(float)
    x[:, 1] = np.where(rng.random(250) < 0.8, x[:, 0], x[:, 1])
    treated = rng.random(250) < 1 / (1 + np.exp(-(x @ rng.normal(0, 0.7, 30) - 0.5)))
    pop = frame([(1, 2, 9, int(t), i, "2000-01-01") for i, t in enumerate(treated)],
                "target_id long, comparator_id long, outcome_id long, treatment int, subject_id long, cohort_start_date date")
    cov = frame([(1 if treated[i] else 2, i, "2000-01-01", j + 1, 1.0) for i, j in np.argwhere(x).tolist()],
                "cohort_definition_id long, subject_id long, cohort_start_date date, covariate_id long, covariate_value double")
    for variance in (0.05, 1.0):
        scored, fits, inside = PS.propensity_fits(pop, cov, variance=variance, tolerance=1e-5)
        ps = np.zeros(250)
        for row in scored.collect():
            ps[row.subject_id] = row.ps
        slope, penalty = x.T @ (ps - treated), math.sqrt(2 / variance)
        beta = {row.covariate_id: row.coefficient for row in inside.collect()}
        assert fits.first().converged and abs((ps - treated).sum()) < 5e-3 and len(beta) > 3
        for j in range(30):
            b = beta.get(j + 1, 0.0)
            assert abs(slope[j] + penalty * np.sign(b)) < 5e-3 if b else abs(slope[j]) <= penalty + 5e-3


def test_propensity_without_covariates_and_unconverged(frame):
    _, treated, pop, cov = model_rows(frame, 80)
    scored, fits, coefficients = PS.propensity_fits(pop, cov.limit(0), variance=1.0)
    assert {round(r.ps, 6) for r in scored.collect()} == {round(float(treated.mean()), 6)}
    assert [r.covariate_id for r in coefficients.collect()] == [0]
    _, fits, _ = PS.propensity_fits(pop, cov, variance=1.0, max_iter=1, tolerance=1e-12)
    assert not fits.first().converged


@pytest.mark.parametrize("outcomes", [1, 12])
def test_covariates_meet_each_entry_once(frame, outcomes):
    """Rows out of the covariate join are the covariate table's, and sums by pattern are few, whatever
    the number of outcomes."""
    _, treated, pop, cov = model_rows(frame, 120)
    rows = pop.drop("outcome_id").crossJoin(frame([(o,) for o in range(outcomes)], "outcome_id long"))
    rows = rows.filter((F.col("subject_id") % 5 != 0) | (F.col("outcome_id") % 2 == 0))
    sums = PS.covariate_sums(rows.select(*P.MODEL, *P.ROW), cov, [])
    joined = cov.join(PS.entry_of(rows).select(*PS.ENTRY).distinct(), PS.ENTRY).count()
    assert joined == cov.count()
    got = {(r.outcome_id, r.treatment, r.covariate_id): (r.x, r.xx) for r in sums.collect()}
    want = {}
    for r in PS.entry_of(rows).join(cov, PS.ENTRY).collect():
        k = (r.outcome_id, r.treatment, r.covariate_id)
        old = want.get(k, (0.0, 0.0))
        want[k] = old[0] + r.covariate_value, old[1] + r.covariate_value**2
    assert got == want


def test_correlation_and_guard(frame):
    x, treated, pop, cov = model_rows(frame)
    got = {r.covariate_id: r.correlation for r in PS.treatment_correlation(pop, cov).collect()}
    for j in range(3):
        assert got[j + 1] == pytest.approx(np.corrcoef(x[:, j], treated)[0, 1], abs=1e-9)
    PS.correlation_guard(pop, cov, 0.9)
    with pytest.raises(ValueError):
        PS.correlation_guard(pop, cov, 0.05)


def test_balance_against_numpy_and_of_a_self_match(frame):
    x, treated, pop, cov = model_rows(frame)
    rows = {r.covariate_id: r for r in B.balance(pop, pop, cov).collect()}
    for j in range(3):
        t, c = x[treated, j].astype(float), x[~treated, j].astype(float)
        want = (t.mean() - c.mean()) / math.sqrt((t.var(ddof=1) + c.var(ddof=1)) / 2)
        assert rows[j + 1].before_std_diff == pytest.approx(want, abs=1e-9)
        assert rows[j + 1].after_std_diff == pytest.approx(want, abs=1e-9)
    twins = pop.unionByName(pop.withColumn("treatment", 1 - F.col("treatment")))
    both = cov.unionByName(cov.withColumn("cohort_definition_id", 3 - F.col("cohort_definition_id")))
    assert B.balance(twins, twins, both).filter("abs(before_std_diff) > 1e-12").isEmpty()


@pytest.mark.parametrize("per_bucket", [200_000, 4])
def test_settling_ranges_equals_sequential_greedy_in_few_rounds(frame, monkeypatch, per_bucket):
    monkeypatch.setattr(M, "GROUPS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(M, "MANY_GROUPS", 0)
    rounds = []
    monkeypatch.setattr(M, "_round", lambda state, keys, f=M._round: rounds.append(1) or f(state, keys))
    rng = random.Random(7)
    rows, cases, at = [], {}, 10**8
    for m in range(12):
        # The last ones are chains of ever smaller gaps, a round per link before.
        case = [(int(rng.random() < 0.45), m * 1000 + i, round(rng.uniform(0.1, 0.9), 2 + m % 3) * M.SCORE_UNIT) for i in range(rng.randint(2, 40))]
        if m >= 10:
            case, at = [], 10**8
            for i in range(40):
                case.append((i % 2, m * 1000 + i, at))
                at += 10**6 - 2 * 10**4 * i
        cases[m] = [(a, i, round(k)) for a, i, k in case]
        rows += [(m, a, i, "2000-01-01", k / M.SCORE_UNIT) for a, i, k in cases[m]]
    got = M.match(frame(rows, SCORED), ["m"], 0.08, "propensity score").collect()
    for m, case in cases.items():
        strata = {}
        for r in got:
            if r.m == m:
                strata.setdefault(r.stratum_id, {})[r.treatment] = r.subject_id
        assert {(s[1], s[0]) for s in strata.values()} == greedy(case, math.floor(0.08 * M.SCORE_UNIT))
    assert len(rounds) == 0 if per_bucket > 40 else 0 < len(rounds) <= 12
