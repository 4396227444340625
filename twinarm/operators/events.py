"""Domain events selected by concept set, and primary events in observation."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinarm.operators.ranking import id_range, sliced_row_number
from twinarm.sources.cdm import Cdm

EVENT_COLUMNS = ["person_id", "event_id", "start_date", "end_date", "target_concept_id"]


@dataclass(frozen=True)
class Domain:
    table: str
    id_column: str
    concept_column: str
    start_column: str
    end_column: str | None = None


# Table and column names of the event domains.
DOMAINS = {
    "drug_era": Domain(
        "drug_era", "drug_era_id", "drug_concept_id", "drug_era_start_date", "drug_era_end_date"
    ),
    "condition_era": Domain(
        "condition_era",
        "condition_era_id",
        "condition_concept_id",
        "condition_era_start_date",
        "condition_era_end_date",
    ),
    "condition_occurrence": Domain(
        "condition_occurrence",
        "condition_occurrence_id",
        "condition_concept_id",
        "condition_start_date",
        "condition_end_date",
    ),
    "procedure_occurrence": Domain(
        "procedure_occurrence",
        "procedure_occurrence_id",
        "procedure_concept_id",
        "procedure_date",
    ),
    "death": Domain("death", "person_id", "cause_concept_id", "death_date"),
}


def end_or_next_day(start: str, end: str | None) -> Column:
    """End of an event; the day after its start where no end is known."""
    next_day = F.date_add(F.col(start), 1)
    return F.coalesce(F.col(end), next_day) if end else next_day


def at_visits(records: DataFrame, visits: DataFrame, visit_types: tuple[int, ...]) -> DataFrame:
    """Records made at a visit of one of the types.

    Spark moves a semi join below the joins that pick the records, and would shuffle all of them by visit;
    an inner join with distinct visits stays where it is.
    """
    keys = ["visit_occurrence_id", "person_id"]
    chosen = visits.filter(F.col("visit_concept_id").isin(*visit_types)).select(*keys).distinct()
    return records.join(chosen, keys).select(*records.columns)


def domain_events(
    cdm: Cdm,
    codesets: DataFrame | None,
    domain: str,
    codeset_ids: list[int] | None = None,
    first: bool = False,
    date_range: tuple[datetime.date, datetime.date] | None = None,
    visit_types: tuple[int, ...] | None = None,
    record_types: tuple[int, ...] | None = None,
) -> DataFrame:
    """Events of one domain, tagged with the concept set that selected them.

    One scan serves all requested sets. ``first`` keeps the earliest event of a person and set and
    is applied before the date, visit and record-type filters. Without ``codeset_ids`` every event
    is kept under a NULL set.
    """
    spec = DOMAINS[domain]
    table = cdm[spec.table]
    extra = [
        c for c in ("visit_occurrence_id", "condition_type_concept_id") if c in table.columns
    ]
    concept = (
        F.coalesce(F.col(spec.concept_column), F.lit(0))
        if domain == "death"
        else F.col(spec.concept_column)
    )
    events = table.select(
        "person_id",
        F.col(spec.id_column).cast("long").alias("event_id"),
        F.col(spec.start_column).alias("start_date"),
        end_or_next_day(spec.start_column, spec.end_column).alias("end_date"),
        concept.cast("long").alias("target_concept_id"),
        *extra,
    )
    if codeset_ids is None:
        events = events.withColumn("codeset_id", F.lit(None).cast("int"))
    else:
        chosen = codesets.filter(F.col("codeset_id").isin(codeset_ids))
        events = events.join(
            chosen, F.col("target_concept_id") == F.col("concept_id")
        ).drop("concept_id")
    if first:
        rest = [c for c in events.columns if c not in ("codeset_id", "person_id")]
        rest = ["start_date", "event_id"] + [
            c for c in rest if c not in ("start_date", "event_id")
        ]
        events = (
            events.groupBy("codeset_id", "person_id")
            .agg(F.min(F.struct(*rest)).alias("e"))
            .select("codeset_id", "person_id", "e.*")
        )
    if date_range is not None:
        events = events.filter(F.col("start_date").between(*map(F.lit, date_range)))
    if record_types is not None:
        events = events.filter(F.col("condition_type_concept_id").isin(*record_types))
    if visit_types is not None:
        events = at_visits(events, cdm["visit_occurrence"], visit_types)
    return events.select("codeset_id", *EVENT_COLUMNS)


def in_observation(events: DataFrame, observation_period: DataFrame) -> DataFrame:
    """Join each event to the observation period that holds its start.

    The periods of a person do not overlap, so an event meets at most one.
    """
    periods = observation_period.select(
        F.col("person_id").alias("op_person_id"),
        F.col("observation_period_start_date").alias("op_start_date"),
        F.col("observation_period_end_date").alias("op_end_date"),
    )
    return events.join(
        periods,
        (F.col("person_id") == F.col("op_person_id"))
        & F.col("start_date").between(F.col("op_start_date"), F.col("op_end_date")),
    ).drop("op_person_id")


def first_event(events: DataFrame) -> DataFrame:
    """Earliest event per person in the total order start, end, source, event id."""
    order = ["start_date", "end_date", "source", "event_id"]
    rest = [c for c in events.columns if c not in ("person_id", *order)]
    return (
        events.groupBy("person_id")
        .agg(F.min(F.struct(*order, *rest)).alias("e"))
        .select("person_id", "e.*")
    )


def primary_events(
    sources: list[DataFrame],
    observation_period: DataFrame,
    prior_days: int = 0,
    post_days: int = 0,
    limit: str = "All",
) -> DataFrame:
    """Union of the primary criteria, joined to observation.

    With limit ``First`` the first event of a person is chosen before the observation rules apply:
    where it fails them the person is dropped.
    """
    union = None
    for position, events in enumerate(sources):
        tagged = events.select(*EVENT_COLUMNS[:-1]).withColumn("source", F.lit(position))
        union = tagged if union is None else union.unionByName(tagged)
    if limit == "First":
        union = first_event(union)
    return in_observation(union, observation_period).filter(
        (F.date_add("op_start_date", prior_days) <= F.col("start_date"))
        & (F.date_add("start_date", post_days) <= F.col("op_end_date"))
    )


def number_events(events: DataFrame, name: str = "event_ordinal") -> DataFrame:
    """Position of each event within its person by start, end, source and event id, the order of
    ``first_event``."""
    return sliced_row_number(
        events,
        ["person_id"],
        [F.col("start_date"), F.col("end_date"), F.col("source"), id_range("event_id")],
        [F.col("event_id")],
        name,
    )
