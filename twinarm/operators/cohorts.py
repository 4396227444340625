"""Cohort rows from qualified events, outcome and control cohorts, attrition."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.operators.criteria import Correlated, Criterion, Group, criterion_events, filter_group, group_mask
from twinarm.operators.events import end_or_next_day, first_event, primary_events
from twinarm.operators.reach import near_index
from twinarm.session import small_side
from twinarm.sources.cdm import Cdm

COHORT_COLUMNS = ["cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"]


@dataclass(frozen=True)
class InclusionRule:
    name: str
    group: Group


@dataclass(frozen=True)
class CohortDefinition:
    cohort_id: int
    primary: tuple[Criterion, ...]
    prior_days: int = 0
    post_days: int = 0
    primary_limit: str = "All"
    group: Group | None = None
    qualified_limit: str = "All"
    expression_limit: str = "All"
    rules: tuple[InclusionRule, ...] = ()


def limit_events(events: DataFrame, limit: str) -> DataFrame:
    return first_event(events) if limit == "First" else events


def inclusion_mask(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Bit mask of the inclusion rules each event meets; ``rules`` names them per event."""
    keys = ["person_id", "source", "event_id"]
    masks = rules.groupBy(*keys).agg(
        F.sum(F.expr("shiftleft(1L, cast(inclusion_rule_id as int))")).alias("mask")
    )
    return (
        events.join(masks, keys, "left")
        .withColumn("inclusion_rule_mask", F.coalesce("mask", F.lit(0)).cast("long"))
        .drop("mask")
    )


def meets_all_rules(masked: DataFrame, rule_count: int) -> DataFrame:
    return masked.filter(F.col("inclusion_rule_mask") == F.lit((1 << rule_count) - 1))


def qualified_events(cdm: Cdm, codesets: DataFrame, definition: CohortDefinition) -> DataFrame:
    """Primary events that meet the criteria group, after the qualified-event limit."""
    sources = [
        criterion_events(
            cdm, codesets, c, None if c.codeset_id is None else [c.codeset_id]
        )
        for c in definition.primary
    ]
    events = primary_events(
        sources,
        cdm["observation_period"],
        definition.prior_days,
        definition.post_days,
        definition.primary_limit,
    )
    if definition.group is not None:
        events = filter_group(events, definition.group, cdm, codesets)
    if definition.primary_limit != "First":
        events = limit_events(events, definition.qualified_limit)
    return events


def build_cohort(events: DataFrame, cohort_id: int, ends: DataFrame | None = None) -> DataFrame:
    """Cohort rows of events that end with observation, or at the earliest of the given ends.

    ``ends`` holds ``(person_id, source, event_id, cohort_end)`` candidates; those before the start
    of their event do not count.
    """
    if ends is None:
        closed = events.withColumn("cohort_end", F.col("op_end_date")).filter(
            F.col("cohort_end") >= F.col("start_date")
        )
    else:
        keys = ["person_id", "source", "event_id"]
        starts = events.select(*keys, "start_date")
        closed = (
            starts.join(ends, keys)
            .filter(F.col("cohort_end") >= F.col("start_date"))
            .groupBy(*keys, "start_date")
            .agg(F.min("cohort_end").alias("cohort_end"))
        )
    return closed.select(
        F.lit(cohort_id).cast("long").alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        F.col("cohort_end").alias("cohort_end_date"),
    )


def ruled_events(cdm: Cdm, codesets: DataFrame, definition: CohortDefinition) -> DataFrame:
    """Qualified events with the mask of the inclusion rules they meet, all rules decided in one pass."""
    events = qualified_events(cdm, codesets, definition)
    return group_mask(events, [r.group for r in definition.rules], cdm, codesets, "inclusion_rule_mask")


def rule_attrition(masked: DataFrame, definition: CohortDefinition) -> DataFrame:
    """Persons and events left after each inclusion rule: those that meet it and all rules before.

    A person survives as long as any of its events does, which is one number for each person, so
    all steps come from one aggregate.
    """
    names = ["qualified events", *[r.name for r in definition.rules]]
    # The lowest bit that is missing ends the run of rules met.
    met = F.lit(len(names) - 1)
    for i in range(len(definition.rules) - 1, -1, -1):
        met = F.when(F.col("inclusion_rule_mask").bitwiseAND(F.lit(1 << i)) == 0, F.lit(i)).otherwise(met)
    persons = masked.groupBy("person_id").agg(
        F.max(met).alias("last"),
        *[F.sum(F.when(met == i, 1).otherwise(0)).alias(f"events_{i}") for i in range(len(names))],
    )
    ended = persons.groupBy("last").agg(
        F.count("*").alias("persons"), *[F.sum(f"events_{i}").alias(f"events_{i}") for i in range(len(names))]
    )
    total = ended.agg(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("label"),
            F.coalesce(F.sum(F.when(F.col("last") >= i, F.col("persons"))), F.lit(0)).alias("persons"),
            F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.col(f"events_{j}") for j in range(i, len(names))])), F.lit(0)).alias("events"),
        ).alias(f"s{i}")
        for i, name in enumerate(names)
    ])
    return total.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))])))


def cohort_from_definition(
    cdm: Cdm, codesets: DataFrame, definition: CohortDefinition
) -> DataFrame:
    if definition.rules:
        masked = ruled_events(cdm, codesets, definition)
        events = meets_all_rules(masked, len(definition.rules)).drop("inclusion_rule_mask")
    else:
        events = qualified_events(cdm, codesets, definition)
    if definition.primary_limit != "First" and definition.qualified_limit != "First":
        events = limit_events(events, definition.expression_limit)
    return build_cohort(events, definition.cohort_id)


def negative_control_cohorts(
    cohorts: DataFrame,
    conditions: DataFrame,
    ancestor: DataFrame,
    treatment_ids: DataFrame,
    control_ids: DataFrame,
) -> DataFrame:
    """Conditions under a control concept on or after each treatment entry.

    One row per entry, condition and control concept; nothing is deduplicated.
    """
    controls = small_side(
        ancestor.join(
            small_side(control_ids),
            F.col("ancestor_concept_id") == F.col("concept_id"),
            "left_semi",
        )
    )
    entries = cohorts.join(
        small_side(treatment_ids), "cohort_definition_id", "left_semi"
    ).select("subject_id", "cohort_start_date")
    later = near_index(entries, conditions, "condition_start_date", before=0, after=None)
    under = later.join(
        controls, F.col("condition_concept_id") == F.col("descendant_concept_id")
    ).select(
        F.col("ancestor_concept_id").alias("cohort_definition_id"),
        "person_id",
        "condition_start_date",
        end_or_next_day("condition_start_date", "condition_end_date").alias("cohort_end_date"),
    )
    return under.join(
        entries,
        (F.col("person_id") == F.col("subject_id"))
        & (F.col("condition_start_date") >= F.col("cohort_start_date")),
    ).select(
        "cohort_definition_id",
        "subject_id",
        F.col("condition_start_date").alias("cohort_start_date"),
        "cohort_end_date",
    )


def treatment_ids(comparisons: DataFrame) -> DataFrame:
    """Distinct target and comparator ids."""
    return (
        comparisons.select(F.col("target_id").alias("cohort_definition_id"))
        .union(comparisons.select("comparator_id"))
        .distinct()
    )


def attrition(steps: list[tuple[str, DataFrame]], arm: list[str], subject: str) -> DataFrame:
    """Distinct subjects left after each step, per arm."""
    rows = [
        df.select(F.lit(i).alias("step"), F.lit(label).alias("label"), *arm, F.col(subject))
        for i, (label, df) in enumerate(steps)
    ]
    return (
        reduce(DataFrame.unionByName, rows)
        .groupBy("step", "label", *arm)
        .agg(F.count_distinct(F.col(subject)).alias("subjects"))
    )


def steps_survived(steps: list[tuple[str, DataFrame]], keys: list[str], subject: str) -> DataFrame:
    """Subjects left after each step by ``keys``, where a step's table holds ``last``, the number of the
    last step that its rows have passed; ``steps`` names them in order. A subject counts with the
    furthest of its rows, so one aggregate serves all steps, and no subject is counted distinctly.
    """
    rows = reduce(DataFrame.unionByName, [df.select(*keys, F.col(subject).alias("subject"), "last") for _, df in steps if df is not None])
    furthest = rows.groupBy(*keys, "subject").agg(F.max("last").alias("last"))
    ended = furthest.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("last") >= i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(steps))
    ])
    lines = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("subjects")) for i, (label, _) in enumerate(steps)
    ])
    return ended.select(*keys, F.inline(lines))


def study_attrition(
    arms: DataFrame, grid: DataFrame, judged: DataFrame, matched: DataFrame, min_days: int = 1
) -> DataFrame:
    """Subjects of each arm and model left from cohort entry to the matched set.

    ``judged`` are the entries of one arm only with their outcomes (``with_outcomes``); ``grid`` is the
    caller's short list of models.
    """
    model = ["target_id", "comparator_id", "outcome_id"]
    sides = F.explode(F.array(
        F.struct(F.col("target_id").alias("cohort_definition_id"), F.lit(1).alias("treatment")),
        F.struct(F.col("comparator_id").alias("cohort_definition_id"), F.lit(0).alias("treatment")),
    ))
    models = grid.select(*model, sides.alias("side")).select(*model, "side.*")
    entered = arms.select("cohort_definition_id", "subject_id").join(F.broadcast(models), "cohort_definition_id")
    passed = F.when(F.col("prior_outcome"), 1).when(F.col("time_at_risk") < min_days, 2).otherwise(3)
    return steps_survived(
        [
            ("cohort entry", entered.withColumn("last", F.lit(0))),
            ("in one arm only", judged.withColumn("last", passed)),
            ("no earlier outcome", None),
            ("enough time at risk", None),
            ("matched", matched.withColumn("last", F.lit(4))),
        ],
        [*model, "treatment"],
        "subject_id",
    )


def _window_days(side: dict) -> int | None:
    if side.get("Days") is None:
        return None
    return int(side["Days"]) * int(side["Coeff"])


# Criterion names of cohort-definition JSON and the tables they read.
JSON_DOMAINS = {
    "DrugEra": "drug_era",
    "ConditionEra": "condition_era",
    "ConditionOccurrence": "condition_occurrence",
    "ProcedureOccurrence": "procedure_occurrence",
    "Death": "death",
}


# What the readers below understand of a criterion and of a definition.
CRITERION_KEYS = {
    "CodesetId", "First", "OccurrenceStartDate", "VisitType", "ConditionType", "CorrelatedCriteria",
}


def _refuse(what: str, spec: dict, known: set[str]) -> None:
    """A part that is not understood changes who is in the cohort, so it is never passed over."""
    extra = sorted(k for k, v in spec.items() if k not in known and v not in (None, [], {}, False))
    if extra:
        raise ValueError(f"unsupported in {what}: {', '.join(extra)}")


def _criterion_from_json(spec: dict) -> Criterion:
    ((name, body),) = spec.items()
    if name not in JSON_DOMAINS:
        raise ValueError(f"unsupported criterion: {name}")
    _refuse(name, body, CRITERION_KEYS)
    span = body.get("OccurrenceStartDate")
    if span is not None and span["Op"] != "bt":
        raise ValueError(f"unsupported date operator {span['Op']}")

    def ids(key: str) -> tuple[int, ...] | None:
        return tuple(c["CONCEPT_ID"] for c in body[key]) if body.get(key) else None

    return Criterion(
        JSON_DOMAINS[name],
        body.get("CodesetId"),
        bool(body.get("First", False)),
        tuple(datetime.date.fromisoformat(span[k]) for k in ("Value", "Extent")) if span else None,
        ids("VisitType"),
        ids("ConditionType"),
        _group_from_json(body["CorrelatedCriteria"]) if body.get("CorrelatedCriteria") else None,
    )


def _group_from_json(spec: dict) -> Group:
    if spec["Type"] not in ("ALL", "ANY"):
        raise ValueError(f"unsupported group type: {spec['Type']}")
    _refuse("a group", spec, {"Type", "CriteriaList", "Groups"})
    members: list[Correlated | Group] = []
    for entry in spec["CriteriaList"]:
        window, occurrence = entry["StartWindow"], entry["Occurrence"]
        count = int(occurrence["Count"])
        # Occurrence types: 0 exactly, 1 at most, 2 at least.
        kind = int(occurrence["Type"])
        members.append(
            Correlated(
                _criterion_from_json(entry["Criteria"]),
                _window_days(window["End"]),
                _window_days(window["Start"]),
                count if kind == 2 or (kind == 0 and count > 0) else None,
                count if kind in (0, 1) else None,
            )
        )
    members += [_group_from_json(g) for g in spec.get("Groups", [])]
    return Group(spec["Type"], tuple(members))


def definition_from_json(cohort_id: int, spec: dict) -> CohortDefinition:
    """A stored cohort definition (already loaded) as a ``CohortDefinition``."""
    for part in ("CensoringCriteria", "EndStrategy"):
        if spec.get(part):
            raise ValueError(f"unsupported in a definition: {part}")
    for rule in spec.get("InclusionRules") or []:
        _refuse("an inclusion rule", rule, {"name", "description", "expression"})
        if not rule.get("expression"):
            raise ValueError("unsupported in an inclusion rule: no expression")
    primary = spec["PrimaryCriteria"]
    extra = spec.get("AdditionalCriteria")
    return CohortDefinition(
        cohort_id,
        tuple(_criterion_from_json(c) for c in primary["CriteriaList"]),
        int(primary["ObservationWindow"]["PriorDays"]),
        int(primary["ObservationWindow"]["PostDays"]),
        primary["PrimaryCriteriaLimit"]["Type"],
        _group_from_json(extra) if extra else None,
        spec["QualifiedLimit"]["Type"],
        spec["ExpressionLimit"]["Type"],
        tuple(
            InclusionRule(r.get("name", ""), _group_from_json(r["expression"]))
            for r in spec.get("InclusionRules") or []
        ),
    )


_DOMAIN_NAMES = {table: name for name, table in JSON_DOMAINS.items()}


def _criterion_to_json(c: Criterion) -> dict:
    body: dict = {}
    if c.codeset_id is not None:
        body["CodesetId"] = c.codeset_id
    if c.first:
        body["First"] = True
    if c.date_range:
        body["OccurrenceStartDate"] = {"Value": str(c.date_range[0]), "Extent": str(c.date_range[1]), "Op": "bt"}
    for key, ids in (("VisitType", c.visit_types), ("ConditionType", c.record_types)):
        if ids:
            body[key] = [{"CONCEPT_ID": i} for i in ids]
    if c.nested:
        body["CorrelatedCriteria"] = _group_to_json(c.nested)
    return {_DOMAIN_NAMES[c.domain]: body}


def _side_to_json(days: int | None) -> dict:
    return {"Coeff": -1} if days is None else {"Days": abs(days), "Coeff": -1 if days < 0 else 1}


def _group_to_json(group: Group) -> dict:
    entries, groups = [], []
    for member in group.members:
        if isinstance(member, Group):
            groups.append(_group_to_json(member))
            continue
        if member.min_count is not None and member.max_count is not None and member.min_count != member.max_count:
            raise ValueError("a stored definition has no count between two numbers")
        kind, count = (0, member.min_count) if member.min_count == member.max_count else (
            (2, member.min_count) if member.max_count is None else (1, member.max_count))
        if kind == 1 and count == 0:
            kind = 0
        entries.append({
            "Criteria": _criterion_to_json(member.criterion),
            "StartWindow": {"Start": _side_to_json(member.lower_offset), "End": _side_to_json(member.upper_offset)},
            "Occurrence": {"Type": kind, "Count": count},
        })
    return {"Type": group.mode, "CriteriaList": entries, "Groups": groups}


def definition_to_json(definition: CohortDefinition) -> dict:
    """A definition in the form that ``definition_from_json`` reads."""
    spec = {
        "PrimaryCriteria": {
            "CriteriaList": [_criterion_to_json(c) for c in definition.primary],
            "ObservationWindow": {"PriorDays": definition.prior_days, "PostDays": definition.post_days},
            "PrimaryCriteriaLimit": {"Type": definition.primary_limit},
        },
        "QualifiedLimit": {"Type": definition.qualified_limit},
        "ExpressionLimit": {"Type": definition.expression_limit},
        "InclusionRules": [{"name": r.name, "expression": _group_to_json(r.group)} for r in definition.rules],
    }
    if definition.group is not None:
        spec["AdditionalCriteria"] = _group_to_json(definition.group)
    return spec
