"""Empirical calibration against negative controls.

The systematic error of a comparison is N(mu, sigma^2), mu uniform and sigma half-normal. Its posterior
is taken on a grid that each comparison lays around its own controls: mu as many standard errors from
their mean as ``mu_reach``, sigma up to several times their spread. Points of sigma lie evenly on the
log scale, so each carries its sigma as a weight; the low end of the grid then holds next to nothing,
wherever it lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.functions.mathx import two_sided_p
from twinarm.operators.population import PAIR

COMPARISON = ["analysis_id", *PAIR]


@dataclass(frozen=True)
class Grid:
    mu_reach: float = 6.0  # standard errors of the mean, at the controls' spread and the prior's
    mu_points: int = 101
    sigma_low: float = 0.01
    sigma_high: float = 2.0  # at least; more where the controls spread wider
    sigma_reach: float = 4.0
    sigma_points: int = 100
    sigma_scale: float = 0.5  # of the half-normal prior

    def box(self, controls: DataFrame) -> DataFrame:
        """Middle and half width of mu and highest sigma of each comparison."""
        wide = F.var_pop("log_rr") + F.avg(F.col("se_log_rr") * F.col("se_log_rr")) + F.lit(self.sigma_scale**2)
        return controls.groupBy(*COMPARISON).agg(
            F.avg("log_rr").alias("mu_middle"),
            (F.lit(self.mu_reach) * F.sqrt(wide / F.count("*"))).alias("mu_half"),
            F.greatest(F.lit(self.sigma_high), F.lit(self.sigma_reach) * F.stddev_pop("log_rr")).alias("sigma_top"),
        )

    def mu(self, i: Column) -> Column:
        return F.col("mu_middle") + F.col("mu_half") * (i * F.lit(2.0 / (self.mu_points - 1)) - F.lit(1.0))

    def sigma(self, i: Column) -> Column:
        low = F.lit(math.log(self.sigma_low))
        return F.exp(low + i * ((F.log("sigma_top") - low) / F.lit(float(self.sigma_points - 1))))


def null_posterior(controls: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Posterior weight of every grid point, per comparison.

    Each control estimate meets the grid of its comparison, whose size is fixed; sums over the controls
    are combined before the shuffle.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(grid.mu_points * grid.sigma_points - 1)))
    box = grid.box(controls).select(*COMPARISON, "mu_middle", "mu_half", "sigma_top")
    laid = controls.join(box, COMPARISON).select("*", every.alias("point"))
    points = laid.select(
        *COMPARISON,
        "log_rr",
        "se_log_rr",
        "point",
        grid.mu(F.floor(F.col("point") / grid.sigma_points)).alias("mu"),
        grid.sigma(F.col("point") % grid.sigma_points).alias("sigma"),
    )
    mu, sigma = F.col("mu"), F.col("sigma")
    variance = sigma * sigma + F.col("se_log_rr") * F.col("se_log_rr")
    error = F.col("log_rr") - mu
    likelihood = -0.5 * F.log(variance) - error * error / (2.0 * variance)
    summed = points.groupBy(*COMPARISON, "point", "mu", "sigma").agg(F.sum(likelihood).alias("loglik"))
    prior = F.log(sigma) - sigma * sigma / F.lit(2.0 * grid.sigma_scale**2)
    summed = summed.withColumn("loglik", F.col("loglik") + prior)
    peak = summed.groupBy(*COMPARISON).agg(F.max("loglik").alias("peak"))
    weighted = summed.join(peak, COMPARISON).withColumn(
        "weight", F.exp(F.col("loglik") - F.col("peak"))
    )
    total = weighted.groupBy(*COMPARISON).agg(F.sum("weight").alias("total"))
    return weighted.join(total, COMPARISON).select(
        *COMPARISON,
        "point",
        "mu",
        "sigma",
        (F.col("weight") / F.col("total")).alias("weight"),
    )


# Share of the posterior that may lie on the rim of the grid.
EDGE_MASS = 0.05


def null_distribution(posterior: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Posterior mean, and sd as one over the root of the mean precision.

    Fails where more than ``EDGE_MASS`` of a posterior lies in the outer twentieths of mu or on the upper
    end of sigma: the grid is too narrow then, and every number taken from it is wrong.
    """
    w, sigma = F.col("weight"), F.col("sigma")
    i, j = F.floor(F.col("point") / grid.sigma_points), F.col("point") % grid.sigma_points
    rim = max(1, grid.mu_points // 20)
    outer = (i < rim) | (i >= grid.mu_points - rim) | (j == grid.sigma_points - 1)
    found = posterior.groupBy(*COMPARISON).agg(
        F.sum(w * F.col("mu")).alias("null_mean"),
        (1.0 / F.sqrt(F.sum(w / (sigma * sigma)))).alias("null_sd"),
        F.sum(F.when(outer, w).otherwise(0.0)).alias("edge"),
    )
    told = F.raise_error(F.concat_ws(" ", F.lit("posterior on the edge of the grid:"), *COMPARISON, "edge")).cast("double")
    # On both columns: a caller may take only one of them.
    return found.select(
        *COMPARISON, *[F.when(F.col("edge") > EDGE_MASS, told).otherwise(F.col(c)).alias(c) for c in ("null_mean", "null_sd")]
    )


def calibrate(summary: DataFrame, posterior: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Calibrated p: the median, and as bounds the 2.5% and 97.5% points, of p over the posterior.

    An estimate meets one row per grid point of its comparison.
    """
    keys = [*COMPARISON, "outcome_id"]
    spread = F.col("sigma") * F.col("sigma") + F.col("se_log_rr") * F.col("se_log_rr")
    point_z = (F.col("log_rr") - F.col("mu")) / F.sqrt(spread)
    points = (
        summary.select(*keys, "log_rr", "se_log_rr")
        .join(posterior, COMPARISON)
        .select(*keys, "weight", "point", two_sided_p(point_z).alias("p"))
    )
    reached = F.sum("weight").over(Window.partitionBy(*keys).orderBy("p", "point"))

    def at(share: float, name: str) -> Column:
        return F.min(F.when(F.col("reached") >= share, F.col("p"))).alias(name)

    found = points.withColumn("reached", reached).groupBy(*keys).agg(
        at(0.5, "calibrated_p"), at(0.025, "calibrated_p_lb95ci"), at(0.975, "calibrated_p_ub95ci")
    )
    return (
        summary.join(null_distribution(posterior, grid), COMPARISON)
        .join(found, keys, "left")
        .select(
            *summary.columns,
            "calibrated_p",
            "calibrated_p_lb95ci",
            "calibrated_p_ub95ci",
            "null_mean",
            "null_sd",
        )
    )


def effect_plot(
    summary: DataFrame, null: DataFrame, control_ids: DataFrame, points: int = 50,
    max_se: float = 2.0,
) -> DataFrame:
    """Plot data: estimates marked as control or outcome, and the p = 0.05 boundary over se."""
    marked = summary.join(
        F.broadcast(
            control_ids.select(
                F.col("concept_id").cast("long").alias("outcome_id"), F.lit(1).alias("listed")
            )
        ),
        "outcome_id",
        "left",
    ).select(
        *COMPARISON,
        F.when(F.col("listed") == 1, "negative").otherwise("positive").alias("series"),
        F.exp("log_rr").alias("rr"),
        F.col("se_log_rr").alias("se"),
    )
    se = F.col("step") * F.lit(max_se / points)
    half = 1.959964 * F.sqrt(F.col("null_sd") * F.col("null_sd") + se * se)
    lines = (
        null.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step"))
        .select(
            *COMPARISON,
            F.explode(
                F.array(
                    F.struct(
                        F.lit("boundary_low").alias("series"),
                        F.exp(F.col("null_mean") - half).alias("rr"),
                        se.alias("se"),
                    ),
                    F.struct(
                        F.lit("boundary_high").alias("series"),
                        F.exp(F.col("null_mean") + half).alias("rr"),
                        se.alias("se"),
                    ),
                )
            ).alias("p"),
        )
        .select(*COMPARISON, "p.*")
    )
    return marked.unionByName(lines)
