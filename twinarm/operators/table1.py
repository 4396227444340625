"""Descriptive table of the arms before and after matching."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.functions.mathx import ratio

VALUE_COLUMNS = [
    "t_before_n", "t_before_pct", "c_before_n", "c_before_pct", "before_std_diff",
    "t_after_n", "t_after_pct", "c_after_n", "c_after_pct", "after_std_diff",
]
METRICS = ("mean", "sd", "median", "min", "max")
CELLS = [
    (arm, stage, treatment)
    for stage in ("before", "after")
    for arm, treatment in (("t", 1), ("c", 0))
]


@dataclass(frozen=True)
class CovariateSpec:
    """One line of the table: ``kind`` is ``continuous``, ``categorical`` or ``count``."""

    position: int
    label: str
    kind: str


def _cell(stage: str, treatment: int, value: Column) -> Column:
    held = F.col("treatment") == treatment
    if stage == "after":
        held = held & (F.col("after_match") == 1)
    return F.when(held, value)


def rounded(column: Column, digits: int, half_even: bool = False) -> Column:
    return F.bround(column, digits) if half_even else F.round(column, digits)


def continuous_std_diff(mean_t: Column, sd_t: Column, mean_c: Column, sd_c: Column) -> Column:
    """(mean_T - mean_C) over the root of the mean variance, 3 digits; NULL for an empty arm."""
    return F.round(
        ratio(mean_t - mean_c, F.sqrt((sd_t * sd_t + sd_c * sd_c) / 2.0)), 3
    )


def categorical_std_diff(
    hits_t: Column, n_t: Column, hits_c: Column, n_c: Column, sign: str = "comparator_minus_target"
) -> Column:
    """Difference of shares over the sample sd of the pooled 0/1 values, 3 digits.

    The original takes comparator minus target here, against the continuous form.
    """
    n = n_t + n_c
    p = ratio(hits_t + hits_c, n)
    sd = F.sqrt(ratio(n * p * (1.0 - p), n - 1))
    difference = ratio(hits_c, n_c) - ratio(hits_t, n_t)
    if sign == "target_minus_comparator":
        difference = -difference
    return F.round(ratio(difference, sd), 3)


def continuous_block(
    rows: DataFrame, keys: list[str], header: Column | None = None
) -> DataFrame:
    """Mean, sd, median, min and max per arm before and after matching, one line each.

    ``rows``: keys, treatment, score, after_match. ``header`` labels an extra empty line 0.
    """
    score = F.col("score")
    aggs = []
    for arm, stage, treatment in CELLS:
        x = _cell(stage, treatment, score)
        name = f"{arm}_{stage}"
        aggs += [
            F.avg(x).alias(f"{name}_mean"),
            F.stddev_samp(x).alias(f"{name}_sd"),
            F.median(x).alias(f"{name}_median"),
            F.min(x).cast("double").alias(f"{name}_min"),
            F.max(x).cast("double").alias(f"{name}_max"),
        ]
    wide = rows.groupBy(*keys).agg(*aggs)
    lines = []
    if header is not None:
        blank = [F.lit(None).cast("double").alias(c) for c in VALUE_COLUMNS]
        lines.append(F.struct(F.lit(0).alias("line"), header.alias("characteristic"), *blank))
    for line, metric in enumerate(METRICS, start=1):
        fields = [F.lit(line).alias("line"), F.lit(metric).alias("characteristic")]
        for stage in ("before", "after"):
            for arm in ("t", "c"):
                value = F.col(f"{arm}_{stage}_{metric}").cast("double")
                fields.append(value.alias(f"{arm}_{stage}_n"))
                fields.append(F.lit(None).cast("double").alias(f"{arm}_{stage}_pct"))
            diff = F.lit(None).cast("double")
            if metric == "mean":
                diff = continuous_std_diff(
                    F.col(f"t_{stage}_mean"), F.col(f"t_{stage}_sd"),
                    F.col(f"c_{stage}_mean"), F.col(f"c_{stage}_sd"),
                )
            fields.append(diff.alias(f"{stage}_std_diff"))
        lines.append(F.struct(*fields))
    return wide.select(*keys, F.explode(F.array(*lines)).alias("l")).select(
        *keys, "l.line", "l.characteristic", *[f"l.{c}" for c in VALUE_COLUMNS]
    )


def _count_lines(counted: DataFrame, with_diff: bool, keep: list[Column]) -> DataFrame:
    out = list(keep)
    for stage in ("before", "after"):
        for arm in ("t", "c"):
            hits = F.col(f"{arm}_{stage}_hits")
            total = F.col(f"{arm}_{stage}_total")
            out.append(hits.cast("double").alias(f"{arm}_{stage}_n"))
            out.append(F.round(ratio(hits, total) * 100, 3).alias(f"{arm}_{stage}_pct"))
        diff = F.lit(None).cast("double")
        if with_diff:
            diff = categorical_std_diff(
                F.col(f"t_{stage}_hits"), F.col(f"t_{stage}_total"),
                F.col(f"c_{stage}_hits"), F.col(f"c_{stage}_total"),
            )
        out.append(diff.alias(f"{stage}_std_diff"))
    return counted.select(*out)


def count_block(rows: DataFrame, keys: list[str], target: int = 1) -> DataFrame:
    """Rows at the target score and their share of the arm, without a standardised difference."""
    aggs = []
    for arm, stage, treatment in CELLS:
        hit = _cell(stage, treatment, F.when(F.col("score") == target, 1))
        aggs.append(F.count(hit).alias(f"{arm}_{stage}_hits"))
        aggs.append(F.count(_cell(stage, treatment, F.lit(1))).alias(f"{arm}_{stage}_total"))
    counted = rows.groupBy(*keys).agg(*aggs)
    return _count_lines(counted, False, [F.col(k) for k in keys])


def categorical_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every observed category with counts, shares and standardised difference."""
    counts = rows.groupBy(*keys, "category").agg(
        *[
            F.count(_cell(stage, treatment, F.lit(1))).alias(f"{arm}_{stage}_hits")
            for arm, stage, treatment in CELLS
        ]
    )
    names = [f"{arm}_{stage}" for arm, stage, _ in CELLS]
    totals = counts.groupBy(*keys).agg(
        *[F.sum(f"{n}_hits").alias(f"{n}_total") for n in names]
    )
    return _count_lines(
        counts.join(totals, keys), True, [*[F.col(k) for k in keys], F.col("category")]
    )


def table1(
    specs: list[CovariateSpec],
    scores: DataFrame,
    categories: DataFrame,
    flags: DataFrame,
    keys: list[str],
    digits: int = 2,
    half_even: bool = False,
) -> DataFrame:
    """All blocks under one another with a header line per block.

    ``scores`` (label, score), ``categories`` (label, category) and ``flags`` (label, score 0/1)
    carry the keys, treatment and after_match. One aggregate per kind covers every covariate,
    comparison and outcome. Values are rounded to 3 digits inside the blocks and then to ``digits``.
    """
    by = [*keys, "label"]
    place = F.lit(None).cast("int")
    for spec in specs:
        place = F.when(F.col("label") == spec.label, F.lit(spec.position)).otherwise(place)

    def of(kind: str, df: DataFrame) -> DataFrame:
        return df.filter(F.col("label").isin([s.label for s in specs if s.kind == kind]))

    shape = [*by, "line", "characteristic", *VALUE_COLUMNS]
    continuous = continuous_block(of("continuous", scores), by, F.col("label"))
    categorical = categorical_block(of("categorical", categories), by).select(
        "*", F.lit(1).alias("line"), F.col("category").alias("characteristic")
    )
    header = categorical.groupBy(*by).agg(
        F.lit(0).alias("line"),
        F.first("label").alias("characteristic"),
        *[F.first(F.lit(None).cast("double")).alias(c) for c in VALUE_COLUMNS],
    )
    counted = count_block(of("count", flags), by).select(
        "*",
        F.lit(1).alias("line"),
        F.col("label").alias("characteristic"),
    )
    parts = [continuous, header, categorical, counted]
    stacked = reduce(DataFrame.unionByName, [p.select(*shape) for p in parts])
    return stacked.withColumn("position", place).select(
        *keys,
        "position",
        "line",
        "characteristic",
        *[rounded(F.col(c), digits, half_even).alias(c) for c in VALUE_COLUMNS],
    )
