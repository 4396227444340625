"""Cox models stratified on matched sets."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions.mathx import ratio
from twinarm.operators import logistic as L
from twinarm.operators.population import MODEL, ROW
from twinarm.operators.propensity import numbered_models, packed_entries, scaled_squares
from twinarm.session import cut

TREATMENT = 0  # covariate id of the treatment itself
#: Cells of padded strata that are worked on at once, covariates of an information matrix counted in.
CELLS = 500_000
#: Covariates of one information matrix, cells of the matrices of models that are taken together, and steps with the same
#: matrix.
ACTIVE, MATRICES, REFRESH = 1_500, 10_000_000, 3
#: A descent goes on by Newton steps once no optimality condition is broken by more than this an event.
NEAR = 2e-3
#: Rounds over the coordinates of a step, and the share of a step at which no better point is expected.
SWEEPS, SHORTEST = 100, 1e-9
#: Rows of information matrices follow the gradient's blocks.
MATRIX_ROWS = 1 << 20

log = logging.getLogger(__name__)


def pair_counts(matched: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """Discordant counts of 1:1 pairs: events while the partner is still at risk."""
    treated, time = F.col("treatment") == 1, F.col("survival_time")
    event = F.col("outcome_count") > 0
    pairs = matched.groupBy(*keys, "stratum_id").agg(
        F.max(F.when(treated, time)).alias("t_time"),
        F.max(F.when(~treated, time)).alias("c_time"),
        F.bool_or(treated & event).alias("t_event"),
        F.bool_or(~treated & event).alias("c_event"),
    )
    return pairs.groupBy(*keys).agg(
        F.sum(F.when(F.col("t_event") & (F.col("t_time") <= F.col("c_time")), 1).otherwise(0)).alias(
            "n10"
        ),
        F.sum(F.when(F.col("c_event") & (F.col("c_time") <= F.col("t_time")), 1).otherwise(0)).alias(
            "n01"
        ),
    )


def cox_pairs(matched: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """Treatment effect of a Cox model stratified on 1:1 pairs, in closed form (Breslow ties).

    NULL where one arm has no informative event.
    """
    n10, n01 = F.col("n10"), F.col("n01")
    known = (n10 > 0) & (n01 > 0)
    return pair_counts(matched, keys).select(
        *keys,
        F.when(known, F.log(ratio(n10, n01))).alias("log_rr"),
        F.when(known, F.sqrt(ratio(F.lit(1), n10) + ratio(F.lit(1), n01))).alias("se_log_rr"),
    )


class CoxFit(NamedTuple):
    """Coefficients by covariate id, standard error on treatment, and how the descent ended.

    ``se`` is None where the treatment coefficient has no finite optimum, where the covariates of the
    model determine treatment, or where the descent did not converge. ``violation`` is the largest
    breach of an optimality condition an event.
    """

    beta: dict[int, float]
    se: float | None
    converged: bool
    iterations: int
    violation: float


def informative_rows(matched: DataFrame) -> DataFrame:
    """The matched rows that a stratified Cox likelihood depends on: in a stratum with an event, those
    still at risk at its first event, if there are two or more. A stratum is a matched set, so a window
    holds a few rows."""
    stratum = Window.partitionBy(*MODEL, "stratum_id")
    rows = matched.select(
        *MODEL, *ROW, "stratum_id", "survival_time", F.when(F.col("outcome_count") > 0, 1).otherwise(0).alias("event")
    )
    return (
        rows.withColumn("first_event", F.min(F.when(F.col("event") == 1, F.col("survival_time"))).over(stratum))
        .filter("survival_time >= first_event")
        .withColumn("held", F.count("*").over(stratum))
        .filter("held > 1")
        .drop("first_event", "held")
    )


def packed_strata(matched: DataFrame, covariates: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One row per informative stratum, with its subjects and their covariates in it, latest first; the
    models by number; and the position of each covariate in its model (treatment is position 0)."""
    rows = cut(informative_rows(matched))
    models = cut(numbered_models(rows))
    entries = "array<struct<p:int,v:double>>"
    positions = None
    if covariates is None:
        held = rows.withColumn("entries", F.array().cast(entries))
    else:
        packed, positions = packed_entries(rows, covariates, models)
        held = rows.join(packed, [*MODEL, *ROW], "left").withColumn("entries", F.coalesce("entries", F.array().cast(entries)))
    subject = F.struct(
        F.col("survival_time").alias("time"), "event", "treatment", "subject_id", "cohort_start_date",
        F.col("entries.p").alias("positions"), F.col("entries.v").alias("values"),
    )
    strata = (
        held.join(F.broadcast(models), MODEL)
        .groupBy("model", "stratum_id")
        .agg(F.sort_array(F.collect_list(subject), asc=False).alias("s"))
        .select(
            "model", F.col("s.time").alias("time"), F.col("s.event").alias("event"), F.col("s.treatment").alias("treatment"),
            F.transform("s", lambda x: F.size(x["positions"])).alias("widths"),
            F.flatten("s.positions").alias("positions"), F.flatten("s.values").alias("values"),
        )
    )
    return cut(strata), models, positions


class _Strata:
    """Some strata of one model as padded matrices, a row each, latest subject first."""

    def __init__(self, part: pa.RecordBatch):
        def flat(name: str) -> np.ndarray:
            return part.column(name).flatten().to_numpy(zero_copy_only=False)

        time, event, treatment, widths = (flat(c) for c in ("time", "event", "treatment", "widths"))
        size = np.diff(part.column("time").offsets.to_numpy())
        self.rows, self.width = len(time), int(size.max(initial=1))
        self.at = (np.repeat(np.arange(len(size)), size), np.arange(self.rows) - np.repeat(np.cumsum(size) - size, size))
        self.shape = (len(size), self.width)
        days = self.padded(time.astype(np.int64), -1)
        self.event, self.treated = self.padded(event, 0.0), self.padded(treatment, 0.0)
        # Subjects of one day are at risk together: their first and last place.
        self.first, self.last = np.zeros(self.shape, np.int64), np.full(self.shape, self.width - 1)
        for j in range(1, self.width):
            self.first[:, j] = np.where(days[:, j] == days[:, j - 1], self.first[:, j - 1], j)
        for j in range(self.width - 2, -1, -1):
            self.last[:, j] = np.where(days[:, j] == days[:, j + 1], self.last[:, j + 1], j)
        self.position, self.value = flat("positions"), flat("values")
        self.row = np.repeat(np.arange(self.rows), widths)

    def padded(self, values: np.ndarray, fill) -> np.ndarray:
        out = np.full(self.shape, fill, np.result_type(values, type(fill)))
        out[self.at] = values
        return out

    def evaluate(self, beta: np.ndarray) -> None:
        """Log sums over the risk set of each subject's day, weights in them, residuals and loss at ``beta``.

        All on the log scale: subjects of a stratum may differ by more than an exponential can hold.
        """
        eta = np.bincount(self.row, self.value * beta[self.position], self.rows)
        eta = self.padded(eta, -np.inf)
        self.real = np.isfinite(eta)
        self.eta = np.where(self.real, eta + beta[TREATMENT] * self.treated, -np.inf)
        self.held = np.logaddexp.accumulate(self.eta, axis=1)
        self.at_risk = np.take_along_axis(self.held, self.last, axis=1)
        hazard = np.where(self.event > 0, np.log(np.maximum(self.event, 1e-300)) - self.at_risk, -np.inf)
        suffix = np.logaddexp.accumulate(hazard[:, ::-1], axis=1)[:, ::-1]
        self.expected = np.exp(self.eta + np.take_along_axis(suffix, self.first, axis=1))
        self.residual = np.where(self.real, self.expected - self.event, 0.0)
        self.loss = float((self.event[self.real] * (self.at_risk - self.eta)[self.real]).sum())

    def over_risk_set(self, values: np.ndarray) -> np.ndarray:
        return np.take_along_axis(np.cumsum(values, axis=1), self.last, axis=1)

    def told(self) -> tuple[float, float]:
        """Events of either arm while somebody of the other arm is at risk."""
        treated, everyone = self.over_risk_set(self.treated), self.over_risk_set(self.real.astype(np.float64))
        return float((self.event * self.treated * (treated < everyone)).sum()), float((self.event * (1 - self.treated) * (treated > 0)).sum())

    def gradient(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that occur (0 is treatment) and the slopes of the loss there."""
        used, at = np.unique(np.concatenate([[TREATMENT], self.position]), return_inverse=True)
        # Without any entry the counts would be whole numbers.
        slopes = np.bincount(at[1:], self.value * self.residual[self.at][self.row], len(used)).astype(np.float64)
        slopes[0] += (self.residual * self.treated).sum()
        return used, slopes

    def information(self, active: np.ndarray) -> np.ndarray:
        """Second derivatives of the loss between the ``active`` positions (rising, treatment first)."""
        place = np.minimum(np.searchsorted(active, self.position), len(active) - 1)
        hit = active[place] == self.position
        x = np.zeros((*self.shape, len(active)))
        flat = np.zeros((self.rows, len(active)))
        flat[self.row[hit], place[hit]] = self.value[hit]
        x[self.at] = flat
        x[..., 0] = self.treated
        dense = x.reshape(-1, len(active)) * np.sqrt(self.expected).reshape(-1, 1)
        whole = dense.T @ dense
        # Means over those at risk, carried on from place to place.
        for j in range(1, self.width):
            older = np.where(self.real[:, j], np.exp(self.held[:, j - 1] - self.held[:, j]), 1.0)
            own = np.exp(self.eta[:, j] - self.held[:, j])
            x[:, j] = x[:, j - 1] * older[:, None] + x[:, j] * own[:, None]
        means = np.take_along_axis(x, self.last[..., None], axis=1)
        mean = means.reshape(-1, len(active)) * np.sqrt(self.event).reshape(-1, 1)
        return whole - mean.T @ mean


def _strata_of(batch: pa.RecordBatch, room: int) -> Iterator[tuple[int, _Strata]]:
    """Strata of one model at a time, as many as padded cells allow; a larger one stays whole."""
    model = batch.column("model").to_numpy()
    size = np.diff(batch.column("time").offsets.to_numpy())
    a = 0
    for i in range(1, len(model) + 1):
        if i == len(model) or model[i] != model[a] or (i + 1 - a) * int(size[a : i + 1].max()) > room:
            yield int(model[a]), _Strata(batch.slice(a, i - a))
            a = i


def _adder(shared):
    """Losses, gradients and, where positions are named, information matrices, summed over a partition.

    State of a model: its coefficients (a column), whatever stands second, and the active positions or
    a false value.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        widest = max([len(a) for _, _, a in state.values() if isinstance(a, np.ndarray)], default=1)
        sums = L.BlockSums()
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("model").to_numpy(), list(state))))
            for model, strata in _strata_of(batch, max(1, CELLS // widest)) if batch.num_rows else ():
                beta, _, active = state[model]
                strata.evaluate(beta[:, 0])
                sums.add(model, -1, np.array([strata.loss, *strata.told()]))
                used, slopes = strata.gradient()
                sums.scatter(model, used, slopes[:, None])
                if isinstance(active, np.ndarray):
                    for i, row in enumerate(strata.information(active)):
                        sums.add(model, MATRIX_ROWS + i, row)
            if sums.bytes > L.HELD_BYTES:
                yield sums.flush()
        if sums.held:
            yield sums.flush()

    return run


def _pass(strata: DataFrame, state: dict) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    found = L.summed(strata, _adder, state)
    return {m: b[-1][:1] for m, b in found.items()}, {m: L.gradient_of(b, state[m][0].shape) for m, b in found.items()}


def penalized_step(matrix: np.ndarray, slope: np.ndarray, beta: np.ndarray, l1: float) -> np.ndarray:
    """The step that minimises the quadratic model of the loss plus the penalty; the first place is not
    penalised. Where covariates repeat one another the matrix is singular and a plain Newton step may lead
    anywhere; this one always goes downhill. All covariates in use, and those that a condition moves away from
    zero, move at once, and those that would change their sign stop at zero; where that leads to nothing better
    however short, coordinate by coordinate."""
    bend = np.maximum(np.diag(matrix), 1e-12 * max(np.trace(matrix) / len(matrix), 1e-300))
    weight = np.full(len(beta), l1)
    weight[0] = 0.0

    def goal(there: np.ndarray) -> float:
        step = there - beta
        return float(slope @ step + step @ (matrix @ step) / 2 + weight @ np.abs(there))

    to, own, best = beta.copy(), slope.copy(), goal(beta)  # own: slope of the quadratic model at ``to``
    for _ in range(SWEEPS):
        sign = np.where(to != 0, np.sign(to), np.where(np.abs(own) > weight, -np.sign(own), 0.0))
        on = (sign != 0) | (weight == 0)
        push = np.where(on, own + weight * sign, 0.0)
        if np.abs(push).max() <= 1e-9 * l1:
            break
        move = np.zeros(len(to))
        move[on] = -np.linalg.solve(matrix[np.ix_(on, on)] + np.diag(1e-10 * bend[on]), push[on])
        length, there = 1.0, to
        while length > 1e-4:
            trial = to + length * move
            trial[(weight > 0) & (trial * sign < 0)] = 0.0
            if (value := goal(trial)) < best:
                there, best = trial, value
                break
            length /= 2
        if there is to:
            there, own = to.copy(), own.copy()
            for j in range(len(to)):
                at = there[j] - own[j] / bend[j]
                shift = math.copysign(max(abs(at) - weight[j] / bend[j], 0.0), at) - there[j]
                if shift:
                    there[j] += shift
                    own += shift * matrix[j]
            value = goal(there)
            if not value < best:
                break
            best = value
        to = there
        own = slope + matrix @ (to - beta)
    return to - beta


class _Newton:
    """Newton steps of one model between its active covariates, from a point close to the optimum."""

    def __init__(self, beta: np.ndarray, l1: float, iterations: int):
        self.beta, self.l1, self.iterations = beta, l1, iterations
        self.active = self.active_at(np.zeros_like(beta))
        self.goal, self.step, self.from_beta, self.length = math.inf, None, beta, 1.0
        self.se: float | None = None
        self.converged, self.done, self.violation = False, False, math.inf
        self.matrix, self.over, self.age, self.closing = np.zeros((0, 0)), np.zeros(0, np.int64), 0, False

    def asks(self) -> np.ndarray | None:
        """The covariates whose information is wanted with the next sums, if any: a matrix serves for some steps
        while it covers what is active. The standard error takes one at the optimum."""
        fresh = self.age < REFRESH and np.isin(self.active, self.over).all()
        return self.active if self.closing or not fresh else None

    def keep(self, matrix: np.ndarray | None) -> np.ndarray:
        """Information of what is active, from the new matrix or the last one."""
        if matrix is None:
            at = np.searchsorted(self.over, self.active)
            self.age += 1
            return self.matrix[np.ix_(at, at)]
        self.matrix, self.over, self.age = matrix, self.active, 0
        return matrix

    def active_at(self, gradient: np.ndarray) -> np.ndarray:
        """Covariates other than zero, and those that an optimality condition moves away from it."""
        on = (self.beta[:, 0] != 0) | (np.abs(gradient[:, 0]) > self.l1 * (1 + 1e-9))
        on[TREATMENT] = True
        found = np.flatnonzero(on)
        if len(found) > ACTIVE:  # the steepest ones first
            found = np.sort(found[np.argsort(-np.abs(gradient[found, 0]), kind="stable")[:ACTIVE]])
        return found

    def settle(self, loss: float, gradient: np.ndarray, matrix: np.ndarray, allowed: float) -> None:
        """Take the sums at ``beta``: end, step back, or step on."""
        penalty = np.array([self.l1])
        goal = loss + self.l1 * float(np.abs(self.beta[1:]).sum())
        self.iterations += 1
        if not goal <= self.goal + 1e-10 * (1 + abs(self.goal)):  # not a number is no better either
            self.length /= 2
            if self.length < SHORTEST:
                self.beta, self.done = self.from_beta, True
            else:
                self.move()
            return
        self.violation = float(L.violation(self.beta, gradient, penalty)[0])
        self.goal, self.from_beta, self.length = goal, self.beta, 1.0
        if self.violation <= allowed:
            inside = np.union1d([TREATMENT], np.flatnonzero(self.beta[:, 0]))
            if self.age == 0 and np.isin(inside, self.active).all():
                self.converged = self.done = True
                self.se = self.error(matrix)
            self.active, self.closing = inside, True  # once more, for the information of all that is in the model here
            return
        self.closing = False
        self.step = penalized_step(matrix, gradient[self.active, 0], self.beta[self.active, 0], self.l1)
        self.moved = self.active
        self.move()
        self.active = self.active_at(gradient)

    def move(self) -> None:
        """From the last accepted point."""
        beta = self.from_beta.copy()
        beta[self.moved, 0] += self.length * self.step
        self.beta = beta

    def error(self, matrix: np.ndarray) -> float | None:
        """Standard error of treatment from the observed information of the covariates that are in the
        model: what remains of the treatment's own when those are allowed to follow (Schur complement)."""
        on = self.beta[self.active, 0] != 0
        on[0] = False
        own = matrix[0, 0]
        if on.any():
            cross = matrix[0, on]
            own = own - cross @ np.linalg.lstsq(matrix[np.ix_(on, on)], cross, rcond=None)[0]
        return 1.0 / math.sqrt(own) if own > 1e-9 * max(matrix[0, 0], 1e-300) else None


def _polish(strata: DataFrame, state: dict[int, _Newton], events: dict[int, int], max_iter: int, tolerance: float) -> None:
    """Newton steps for all models, those whose matrices fit together at a time."""
    waiting = sorted(state)
    while waiting:
        group: list[int] = []
        cells = 0
        while waiting and (not group or cells + len(state[waiting[0]].active) ** 2 <= MATRICES):
            cells += len(state[waiting[0]].active) ** 2
            group.append(waiting.pop(0))
        for _ in range(max_iter):
            live = {m: state[m] for m in group if not state[m].done}
            if not live:
                break
            asked = {m: s.asks() for m, s in live.items()}
            found = L.summed(strata, _adder, {m: (s.beta, None, False if asked[m] is None else asked[m]) for m, s in live.items()})
            for m, s in live.items():
                blocks = found[m]
                matrix = s.keep(None if asked[m] is None else np.stack([blocks[MATRIX_ROWS + i] for i in range(len(s.active))]))
                s.settle(float(blocks[-1][0]), L.gradient_of(blocks, s.beta.shape), matrix, tolerance * events[m])


def cox(
    matched: DataFrame,
    covariates: DataFrame | None = None,
    l1: float = math.sqrt(2.0),
    max_iter: int = 300,
    tolerance: float = 1e-7,
) -> dict[tuple, CoxFit]:
    """Coefficients and standard error on treatment of every model of the grid.

    Cox models stratified on matched sets with an L1 penalty (``sqrt(2 / v)`` for a Laplace prior of
    variance v) on the covariates, each divided by its largest value; treatment (covariate id 0) is not
    penalised. Strata are packed as rows of their own, so an iteration is one pass over them with one
    small shuffle of sums: proximal gradients for all models together, then Newton steps among the
    covariates in the model. A fit is converged when no optimality condition is broken by more than
    ``tolerance`` an event. The standard error comes from the observed information of treatment and the
    covariates in the model. A model whose arms do not both have an event while the other arm is at
    risk has no finite optimum and is not fitted. The driver holds one group of models' coefficients.
    """
    strata, models, positions = packed_strata(matched, covariates)
    # Each model of the grid, also one without an informative stratum.
    names = {r["model"]: tuple(r[k] for k in MODEL) for r in models.collect()}
    out = {tuple(r): CoxFit({}, None, False, 0, math.inf) for r in matched.select(*MODEL).distinct().orderBy(*MODEL).collect()}
    squares = {m: np.zeros(0) for m in names}
    if positions is not None:
        squares |= scaled_squares(positions)
    events = {r["model"]: r["n"] for r in strata.groupBy("model").agg(
        F.sum(F.aggregate("event", F.lit(0), lambda a, x: a + x)).alias("n")).collect()}
    sizes = {m: (len(squares[m]), events[m], 0.5) for m in names}
    betas: dict[int, np.ndarray] = {}
    for group in L.split(sizes, 1):
        zero = {m: np.zeros((sizes[m][0] + 1, 1)) for m in group}
        told = L.summed(strata, _adder, {m: (zero[m], None, False) for m in group})
        known = [m for m in group if told[m][-1][1] > 0 and told[m][-1][2] > 0]
        if not known:
            continue
        own = {m: sizes[m] for m in known}
        problem = {m: L.Problems(np.array([l1]), np.array([-1]), np.array([-1])) for m in known}
        fitted = L.fit(strata, own, squares, problem, max_iter, NEAR, zero, _pass)
        state = {m: _Newton(f.beta, l1, int(f.iterations[0])) for m, f in fitted.items()}
        _polish(strata, state, events, max_iter, tolerance)
        for m, s in state.items():
            betas[m] = s.beta[:, 0]
            out[names[m]] = CoxFit({TREATMENT: float(s.beta[0, 0])}, s.se, s.converged, s.iterations, s.violation / events[m])
    for m, k, b in _named(positions, betas):
        out[names[m]].beta[k] = b
    open_ones = sum(bool(f.beta) and not f.converged for f in out.values())
    if open_ones:
        log.warning("%d of %d Cox models did not converge in %d iterations", open_ones, len(out), max_iter)
    return out


def _named(positions: DataFrame | None, betas: dict[int, np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """Covariate ids and coefficients, on the covariates' own scale, of what is in the models."""
    inside = [(m, int(p), float(b[p])) for m, b in betas.items() for p in np.flatnonzero(b) if p != TREATMENT]
    if positions is None or not inside:
        return
    held = positions.sparkSession.createDataFrame(inside, "model int, position long, beta double")
    for r in positions.join(F.broadcast(held), ["model", "position"]).select("model", "covariate_id", F.col("beta") / F.col("largest")).collect():
        yield r[0], r[1], r[2]


def cox_grid(matched: DataFrame, covariates: DataFrame | None = None, **options) -> DataFrame:
    """``cox`` as one row per model: ``log_rr`` and ``se_log_rr``, NULL where there is no estimate, and
    whether and after how many iterations the fit converged."""
    return cox_fits(matched, covariates, **options)[0]


def cox_fits(matched: DataFrame, covariates: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``cox_grid`` and the coefficients of the covariates in the models, one row each."""
    found = cox(matched, covariates, **options)
    spark = matched.sparkSession
    keys = "target_id long, comparator_id long, outcome_id long, "
    fitted = [
        (*model, f.beta.get(TREATMENT) if f.se is not None else None, f.se, f.converged, f.iterations)
        for model, f in found.items()
    ]
    inside = [(*model, k, b) for model, f in found.items() for k, b in f.beta.items()]
    return (
        spark.createDataFrame(fitted, keys + "log_rr double, se_log_rr double, converged boolean, iterations int"),
        spark.createDataFrame(inside, keys + "covariate_id long, coefficient double"),
    )
