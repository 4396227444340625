"""Sparse covariates at index, one long table ``(entry, covariate_id, covariate_value)``.

An entry is ``(cohort_definition_id, subject_id, cohort_start_date)``; a covariate id is
``concept_id * 1000 + analysis_id``. Windows are closed: ``index - days .. index``. Records of
persons outside the cohort, or outside a person's reach of days, are dropped before anything is
grouped or multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.operators.events import at_visits
from twinarm.operators.reach import near_index
from twinarm.session import cut, small_side
from twinarm.sources.cdm import Cdm

ENTRY = ["cohort_definition_id", "subject_id", "cohort_start_date"]

# Window lengths in days.
LONG_TERM, MEDIUM_TERM, SHORT_TERM = 180, 120, 30

# Analysis ids of this library.
ANALYSIS = {
    "gender": 1, "race": 2, "ethnicity": 3, "age_band": 4, "index_year": 5, "index_month": 6,
    "condition_long": 101, "condition_short": 102, "condition_inpatient_medium": 103,
    "condition_era_ever": 201, "condition_era_overlap": 202, "condition_group": 210,
    "drug_long": 301, "drug_short": 302,
    "drug_era_long": 401, "drug_era_short": 402, "drug_era_overlap": 403, "drug_era_ever": 404,
    "procedure_long": 501, "procedure_short": 502,
    "observation_long": 601, "observation_short": 602, "observation_count_long": 603,
    "measurement_long": 701, "measurement_short": 702, "measurement_count_long": 703,
    "measurement_below": 704, "measurement_above": 705,
    "charlson": 901, "dcsi": 902, "chads2": 903, "chads2vasc": 904,
}


def covariate_id(concept: Column, analysis: str) -> Column:
    return concept.cast("long") * 1000 + ANALYSIS[analysis]


def _entries(cohort: DataFrame) -> DataFrame:
    return cohort.select(*ENTRY).distinct()


def _one_hot(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[covariate_id(v, a) for a, v in values.items()])
    return (
        rows.select(*ENTRY, F.explode(F.array_compact(pairs)).alias("covariate_id"))
        .withColumn("covariate_value", F.lit(1.0))
    )


def demographics(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Gender, race and ethnicity, age band, index year and index month."""
    about = person.select(
        F.col("person_id").alias("subject_id"),
        "year_of_birth", "gender_concept_id", "race_concept_id", "ethnicity_concept_id",
    )
    rows = _entries(cohort).join(about, "subject_id")
    age = F.year("cohort_start_date") - F.col("year_of_birth")
    return _one_hot(
        rows,
        {
            "gender": F.col("gender_concept_id"),
            "race": F.col("race_concept_id"),
            "ethnicity": F.col("ethnicity_concept_id"),
            "age_band": F.floor(age / 5),
            "index_year": F.year("cohort_start_date"),
            "index_month": F.month("cohort_start_date"),
        },
    )


def _daily(
    table: DataFrame,
    concept: str,
    start: str,
    end: str | None = None,
    flags: dict[str, Column] | None = None,
) -> DataFrame:
    """Records shrunk to one row per person, concept and day, with whether any met each flag."""
    keys = [F.col(concept).cast("long").alias("concept_id"), F.col(start).alias("start_date")]
    aggs = [F.count("*").alias("n")]
    if end:
        aggs.append(F.max(end).alias("end_date"))
    aggs += [F.bool_or(held).alias(f"is_{name}") for name, held in (flags or {}).items()]
    return table.groupBy(F.col("person_id").alias("subject_id"), *keys).agg(*aggs)


def _windowed(
    cohort: DataFrame,
    daily: DataFrame,
    windows: dict[str, int],
    counts: dict[str, int] | None = None,
    flags: dict[str, int] | None = None,
) -> DataFrame:
    """Presence in each window and, where asked, the number of records and the presence of flagged
    ones; one pass for all windows."""
    counts, flags = counts or {}, flags or {}
    reach = max([*windows.values(), *counts.values(), *flags.values()])
    gap = F.date_diff(F.col("cohort_start_date"), F.col("start_date"))
    met = (
        _entries(cohort)
        .join(daily, "subject_id")
        .withColumn("gap", gap)
        .filter(F.col("gap").between(0, reach))
    )
    summed = met.groupBy(*ENTRY, "concept_id").agg(
        F.min("gap").alias("gap"),
        *[
            F.sum(F.when(F.col("gap") <= days, F.col("n"))).alias(f"n_{name}")
            for name, days in counts.items()
        ],
        *[F.min(F.when(F.col(f"is_{name}"), F.col("gap"))).alias(f"gap_{name}") for name in flags],
    )

    def pair(name: str, held: Column, value: Column) -> Column:
        return F.when(
            held,
            F.struct(
                covariate_id(F.col("concept_id"), name).alias("covariate_id"),
                value.cast("double").alias("covariate_value"),
            ),
        )

    pairs = [pair(n, F.col("gap") <= d, F.lit(1.0)) for n, d in windows.items()]
    pairs += [pair(n, F.col(f"n_{n}").isNotNull(), F.col(f"n_{n}")) for n in counts]
    pairs += [pair(n, F.col(f"gap_{n}") <= d, F.lit(1.0)) for n, d in flags.items()]
    return summed.select(
        *ENTRY, F.explode(F.array_compact(F.array(*pairs))).alias("c")
    ).select(*ENTRY, "c.covariate_id", "c.covariate_value")


def _eras(
    cohort: DataFrame, eras: DataFrame, domain: str, windows: dict[str, int] | None = None
) -> DataFrame:
    """Eras that began by index (ever), still run at index (overlap), or end inside a window."""
    start = f"{domain}_era_start_date"
    daily = _daily(
        near_index(cohort, eras, start), f"{domain}_concept_id", start, f"{domain}_era_end_date"
    )
    started = (
        _entries(cohort).join(daily, "subject_id").filter("start_date <= cohort_start_date")
    )
    latest = started.groupBy(*ENTRY, "concept_id").agg(F.max("end_date").alias("end_date"))
    tests = {
        f"{domain}_era_ever": F.lit(True),
        f"{domain}_era_overlap": F.col("end_date") >= F.col("cohort_start_date"),
    }
    for name, days in (windows or {}).items():
        tests[name] = F.col("end_date") >= F.date_sub("cohort_start_date", days)
    pairs = [F.when(held, covariate_id(F.col("concept_id"), n)) for n, held in tests.items()]
    return latest.select(
        *ENTRY, F.explode(F.array_compact(F.array(*pairs))).alias("covariate_id")
    ).withColumn("covariate_value", F.lit(1.0))


def conditions(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    rows = near_index(cohort, cdm["condition_occurrence"], "condition_start_date", LONG_TERM)
    daily = _daily(rows, "condition_concept_id", "condition_start_date")
    return _windowed(
        cohort, daily, {"condition_long": LONG_TERM, "condition_short": SHORT_TERM}
    )


def inpatient_conditions(
    cohort: DataFrame, cdm: Cdm, visit_types: tuple[int, ...] = (9201,)
) -> DataFrame:
    near = near_index(cohort, cdm["condition_occurrence"], "condition_start_date", MEDIUM_TERM)
    rows = at_visits(near, cdm["visit_occurrence"], visit_types)
    daily = _daily(rows, "condition_concept_id", "condition_start_date")
    return _windowed(cohort, daily, {"condition_inpatient_medium": MEDIUM_TERM})


def condition_eras(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    return _eras(cohort, cdm["condition_era"], "condition")


def condition_groups(
    cohort: DataFrame, cdm: Cdm, group_concepts: DataFrame, days: int = LONG_TERM
) -> DataFrame:
    """Conditions of the window rolled up to the group concepts above them."""
    edges = small_side(
        cdm["concept_ancestor"]
        .join(
            group_concepts.select(F.col("concept_id").alias("ancestor_concept_id")),
            "ancestor_concept_id",
            "left_semi",
        )
        .select("ancestor_concept_id", "descendant_concept_id")
    )
    near = near_index(cohort, cdm["condition_occurrence"], "condition_start_date", days)
    rolled = near.join(
        edges, F.col("condition_concept_id") == F.col("descendant_concept_id")
    )
    daily = _daily(rolled, "ancestor_concept_id", "condition_start_date")
    return _windowed(cohort, daily, {"condition_group": days})


def drugs(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    rows = near_index(cohort, cdm["drug_exposure"], "drug_exposure_start_date", LONG_TERM)
    daily = _daily(rows, "drug_concept_id", "drug_exposure_start_date")
    return _windowed(cohort, daily, {"drug_long": LONG_TERM, "drug_short": SHORT_TERM})


def drug_eras(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    return _eras(
        cohort,
        cdm["drug_era"],
        "drug",
        {"drug_era_long": LONG_TERM, "drug_era_short": SHORT_TERM},
    )


def procedures(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    rows = near_index(cohort, cdm["procedure_occurrence"], "procedure_date", LONG_TERM)
    daily = _daily(rows, "procedure_concept_id", "procedure_date")
    return _windowed(
        cohort, daily, {"procedure_long": LONG_TERM, "procedure_short": SHORT_TERM}
    )


def observations(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    rows = near_index(cohort, cdm["observation"], "observation_date", LONG_TERM)
    daily = _daily(rows, "observation_concept_id", "observation_date")
    return _windowed(
        cohort,
        daily,
        {"observation_long": LONG_TERM, "observation_short": SHORT_TERM},
        {"observation_count_long": LONG_TERM},
    )


def measurements(cohort: DataFrame, cdm: Cdm) -> DataFrame:
    """Presence, counts, and values outside the reference range within the long window."""
    value = F.col("value_as_number")
    daily = _daily(
        near_index(cohort, cdm["measurement"], "measurement_date", LONG_TERM),
        "measurement_concept_id",
        "measurement_date",
        flags={
            "measurement_below": value < F.col("range_low"),
            "measurement_above": value > F.col("range_high"),
        },
    )
    return _windowed(
        cohort,
        daily,
        {"measurement_long": LONG_TERM, "measurement_short": SHORT_TERM},
        {"measurement_count_long": LONG_TERM},
        {"measurement_below": LONG_TERM, "measurement_above": LONG_TERM},
    )


def score_covariate(cohort: DataFrame, score: DataFrame, analysis: str) -> DataFrame:
    """A risk score as a covariate valued at the score; score 0 is left out as implicit."""
    rows = score.filter("score <> 0").select("cohort_definition_id", "subject_id", "score")
    return (
        _entries(cohort)
        .join(rows, ["cohort_definition_id", "subject_id"])
        .select(
            *ENTRY,
            covariate_id(F.lit(0), analysis).alias("covariate_id"),
            F.col("score").cast("double").alias("covariate_value"),
        )
    )


# An interaction id is (covariate id * 1000 + year - 1900) * 1000 + this analysis id.
YEAR_INTERACTION = 990


def year_interaction(covariates: DataFrame) -> DataFrame:
    """Each covariate split by index year; ``base_covariate`` gives the covariate back."""
    year = F.year("cohort_start_date") - 1900
    return covariates.withColumn(
        "covariate_id", (F.col("covariate_id") * 1000 + year) * 1000 + YEAR_INTERACTION
    )


def base_covariate(ids: Column) -> Column:
    """The covariate id itself, or the one an interaction was made from."""
    return F.when(ids % 1000 == YEAR_INTERACTION, F.floor(ids / 1_000_000)).otherwise(ids)


def all_families(
    cohort: DataFrame,
    cdm: Cdm,
    group_concepts: DataFrame,
    scores: dict[str, DataFrame] | None = None,
    by_year: bool = False,
) -> DataFrame:
    """Every family in one table; ``scores`` are risk scores by analysis name, ``by_year`` adds the
    interaction of everything with the index year."""
    parts = [
        demographics(cohort, cdm["person"]),
        conditions(cohort, cdm),
        inpatient_conditions(cohort, cdm),
        condition_eras(cohort, cdm),
        condition_groups(cohort, cdm, group_concepts),
        drugs(cohort, cdm),
        drug_eras(cohort, cdm),
        procedures(cohort, cdm),
        observations(cohort, cdm),
        measurements(cohort, cdm),
        *[score_covariate(cohort, score, name) for name, score in (scores or {}).items()],
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(year_interaction(out)) if by_year else out


def exclude_concepts(covariates: DataFrame, ids: DataFrame, ancestor: DataFrame) -> DataFrame:
    """Drop covariates built on the given concepts or on any of their descendants."""
    below = ids.select(F.col("concept_id").alias("ancestor_concept_id")).join(
        ancestor, "ancestor_concept_id"
    )
    gone = small_side(
        below.select(F.col("descendant_concept_id").alias("concept_id"))
        .union(ids.select("concept_id"))
        .distinct()
    )
    base = base_covariate(F.col("covariate_id"))
    # Person and date covariates number their values from 1 on; only record covariates hold concepts.
    return (
        covariates.withColumn("concept_id", F.when(base % 1000 > 100, F.floor(base / 1000)))
        .join(gone, "concept_id", "left_anti")
        .drop("concept_id")
    )


def drop_rare(
    covariates: DataFrame, comparisons: DataFrame, min_subjects: int = 100
) -> DataFrame:
    """Covariates of each comparison (``target_id, comparator_id``) that at least ``min_subjects``
    subjects of its two arms have. ``comparisons`` is the caller's short list.
    """
    pair = ["target_id", "comparator_id"]
    arms = F.broadcast(
        comparisons.select(*pair)
        .distinct()
        .select(*pair, F.explode(F.array(*pair)).alias("cohort_definition_id"))
    )
    paired = covariates.join(arms, "cohort_definition_id")
    common = cut(
        paired.groupBy(*pair, "covariate_id")
        .agg(F.count_distinct("subject_id").alias("subjects"))
        .filter(F.col("subjects") >= min_subjects)
        .select(*pair, "covariate_id")
    )
    return paired.join(small_side(common), [*pair, "covariate_id"], "left_semi").select(
        *pair, *covariates.columns
    )


def drop_listed(covariates: DataFrame, ids: DataFrame) -> DataFrame:
    return covariates.join(small_side(ids), "covariate_id", "left_anti")


