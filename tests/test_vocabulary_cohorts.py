import datetime
import json
import random

import pytest

from pyspark.sql import functions as F

from checks import design
from twinarm.operators import cohorts as C
from twinarm.operators.concept_sets import concept_set_items, resolve_concept_sets
from twinarm.operators.criteria import Correlated, Criterion, Group, filter_group
from twinarm.operators.events import domain_events, number_events, primary_events
from twinarm.operators.ranking import sliced_row_number
from twinarm.sources.cdm import Cdm, definition_criteria, definition_items, read_cohort_definitions
from twinarm.sources.definitions import definition_nodes, documents, node_items

ERA = "condition_era_id long, person_id long, condition_concept_id long, " \
    "condition_era_start_date date, condition_era_end_date date"
DRUG = "drug_era_id long, person_id long, drug_concept_id long, drug_era_start_date date, " \
    "drug_era_end_date date"
PERIOD = "person_id long, observation_period_start_date date, observation_period_end_date date"
CODES = "codeset_id int, concept_id long"


def day(n):
    return str(datetime.date(2010, 1, 1) + datetime.timedelta(days=n))


def test_exclusion_beats_inclusion(spark, frame):
    concept = frame(
        [(1, None, "S"), (2, None, "S"), (3, "D", "S"), (4, None, "S"), (5, None, "S")],
        "concept_id long, invalid_reason string, standard_concept string",
    )
    ancestor = frame(
        [(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (4, 5)],
        "ancestor_concept_id long, descendant_concept_id long",
    )
    items = concept_set_items(
        spark, [(7, 1, False, True), (7, 4, True, True), (8, 4, False, False), (8, 3, False, False)]
    )
    got = {tuple(r) for r in resolve_concept_sets(items, concept, ancestor).collect()}
    assert got == {(7, 1), (7, 2), (8, 4)}
    free = {tuple(r) for r in resolve_concept_sets(items, concept, ancestor, False).collect()}
    assert free == {(7, 1), (7, 2), (7, 3), (8, 4), (8, 3)}


def test_first_ever_is_ranked_before_the_date_range(frame):
    eras = frame(
        [
            (2, 1, 10, day(0), day(3)),
            (3, 1, 10, day(400), day(403)),
            (9, 2, 10, day(400), day(410)),
            (8, 2, 10, day(400), day(405)),
        ],
        DRUG,
    )
    cdm = Cdm({"drug_era": eras}.__getitem__)
    span = (datetime.date(2011, 1, 1), datetime.date(2012, 1, 1))
    got = domain_events(cdm, frame([(1, 10)], CODES), "drug_era", [1], True, span).collect()
    assert [(r.person_id, r.event_id) for r in got] == [(2, 8)]


def test_observation_edges_and_first_limit(frame):
    periods = frame([(p, day(0), day(1000)) for p in range(1, 6)], PERIOD)
    starts = {1: [179], 2: [180], 3: [1000], 4: [1001], 5: [10, 500]}
    events = frame(
        [(p, 100 * p + i, day(d), day(d + 1), 1) for p, ds in starts.items() for i, d in enumerate(ds)],
        "person_id long, event_id long, start_date date, end_date date, target_concept_id long",
    )
    first = primary_events([events], periods, 180, 0, "First")
    assert sorted(r.person_id for r in first.collect()) == [2, 3]
    all_events = primary_events([events], periods, 180, 0, "All")
    assert sorted(r.event_id for r in all_events.collect()) == [200, 300, 501]


def brute(index, events, period, leaf):
    p, start = index
    low, high = period[p]
    if leaf.lower_offset is not None:
        low = max(low, start + leaf.lower_offset)
    n = sum(1 for q, d in events if q == p and low <= d <= min(high, start + leaf.upper_offset))
    return (leaf.min_count is None or n >= leaf.min_count) and (
        leaf.max_count is None or n <= leaf.max_count
    )


def test_groups_agree_with_brute_force(frame):
    rng = random.Random(5)
    people = range(40)
    period = {p: (rng.randint(0, 50), rng.randint(200, 260)) for p in people}
    index = sorted({(p, rng.randint(*period[p])) for p in people for _ in range(4)})
    codes = {s: [(p, rng.randint(-20, 280)) for p in people for _ in range(rng.randint(0, 4))] for s in (1, 2)}
    eras = [(i, p, s, day(d), day(d + 2)) for s in codes for i, (p, d) in enumerate(codes[s])]
    cdm = Cdm(
        {
            "condition_era": frame(eras, ERA),
            "observation_period": frame([(p, day(a), day(b)) for p, (a, b) in period.items()], PERIOD),
        }.__getitem__
    )
    codesets = frame([(1, 1), (2, 2)], CODES)
    rows = frame(
        [(p, day(d), day(period[p][0]), day(period[p][1])) for p, d in index],
        "person_id long, start_date date, op_start_date date, op_end_date date",
    )
    seen = {s: {(p, d) for p, d in ev if period[p][0] <= d <= period[p][1]} for s, ev in codes.items()}
    counted = {s: [e for e in ev if e in seen[s]] for s, ev in codes.items()}
    a = Correlated(Criterion("condition_era", 1), 0, min_count=1)
    b = Correlated(Criterion("condition_era", 2), -1, max_count=0)
    c = Correlated(Criterion("condition_era", 1), 30, lower_offset=-60, min_count=2)
    d = Correlated(Criterion("condition_era", 2), -1, min_count=1, max_count=2)
    for group in (
        Group("ALL", (a, b)),
        Group("ANY", (a, b)),
        Group("ALL", (a, Group("ANY", (c, d)))),
        Group("ANY", (Group("ALL", (b, c)), d)),
    ):
        def holds(member, at):
            if isinstance(member, Group):
                parts = [holds(m, at) for m in member.members]
                return all(parts) if member.mode == "ALL" else any(parts)
            return brute(at, counted[member.criterion.codeset_id], period, member)

        want = sorted((p, day(s)) for p, s in index if holds(group, (p, s)))
        got = filter_group(rows, group, cdm, codesets).collect()
        assert sorted((r.person_id, str(r.start_date)) for r in got) == want


def test_nested_criterion(frame):
    cdm = Cdm(
        {
            # Person 1: drug before diagnosis. 2: same day. 3: diagnosis before observation began.
            "drug_era": frame([(i, i, 10, day(100), day(110)) for i in (1, 2, 3)], DRUG),
            "condition_era": frame(
                [(1, 1, 20, day(120), day(121)), (2, 2, 20, day(100), day(101)), (3, 3, 20, day(-5), day(5))],
                ERA,
            ),
            "observation_period": frame([(i, day(0), day(500)) for i in (1, 2, 3)], PERIOD),
        }.__getitem__
    )
    diagnosed = Group("ALL", (Correlated(Criterion("condition_era", 2), 0, min_count=1),))
    group = Group(
        "ANY", (Correlated(Criterion("drug_era", 1, nested=diagnosed), -1, min_count=1),)
    )
    index = frame(
        [(i, day(200), day(0), day(500)) for i in (1, 2, 3)],
        "person_id long, start_date date, op_start_date date, op_end_date date",
    )
    got = filter_group(index, group, cdm, frame([(1, 10), (2, 20)], CODES)).collect()
    assert [r.person_id for r in got] == [2]


def test_ends_masks_and_numbers(frame):
    events = frame(
        [(1, 0, 5, day(10), day(11), day(0), day(90)), (1, 0, 6, day(10), day(11), day(0), day(90))],
        "person_id long, source int, event_id long, start_date date, end_date date, "
        "op_start_date date, op_end_date date",
    )
    ends = frame(
        [(1, 0, 5, day(5)), (1, 0, 5, day(30)), (1, 0, 5, day(20))],
        "person_id long, source int, event_id long, cohort_end date",
    )
    row = C.build_cohort(events, 3, ends).collect()
    assert [str(r.cohort_end_date) for r in row] == [day(20)]
    rules = frame(
        [(1, 0, 5, 0), (1, 0, 5, 2)],
        "person_id long, source int, event_id long, inclusion_rule_id long",
    )
    masks = {r.event_id: r.inclusion_rule_mask for r in C.inclusion_mask(events, rules).collect()}
    assert masks == {5: 5, 6: 0}
    numbers = sorted(r.event_ordinal for r in number_events(events).collect())
    assert numbers == [1, 2]


def test_sliced_row_number_with_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), "id"
    )
    got = sliced_row_number(rows, ["g"], [F.pmod("id", F.lit(7))], [F.col("id")], "n")
    check = got.groupBy("g").agg(
        F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.count_distinct("n").alias("d"),
    )
    assert check.filter("lo <> 1 or hi <> c or d <> c").isEmpty()


def stored():
    """A definition of our own: two primary criteria, a group of three members, a rule."""
    around = {"Start": {"Days": 40, "Coeff": -1}, "End": {"Days": 7, "Coeff": 1}}
    until = {"Start": {"Coeff": -1}, "End": {"Days": "3", "Coeff": -1}}
    drug = {"Criteria": {"DrugEra": {"CodesetId": 6}}, "StartWindow": around, "Occurrence": {"Type": 1, "Count": 2}}
    spec = {
        "name": "Own ~ a/b",
        "ConceptSets": [
            {"id": 4, "name": "set", "expression": {"items": [
                {"concept": {"CONCEPT_ID": 11, "CONCEPT_NAME": "a"}, "includeDescendants": True},
                {"concept": {"CONCEPT_ID": 12, "CONCEPT_NAME": "b"}, "isExcluded": True},
            ]}},
            {"id": 5, "name": "empty", "expression": {"items": []}},
        ],
        "PrimaryCriteria": {
            "CriteriaList": [
                {"ConditionOccurrence": {
                    "CodesetId": 4, "ConditionType": [{"CONCEPT_ID": 32020}, {"CONCEPT_ID": 32817}],
                    "OccurrenceStartDate": {"Value": "2003-07-15", "Extent": "2009-02-28", "Op": "bt"},
                }},
                {"Death": {}},
            ],
            "ObservationWindow": {"PriorDays": "45", "PostDays": 10},
            "PrimaryCriteriaLimit": {"Type": "All"},
        },
        "AdditionalCriteria": {
            "Type": "ANY",
            "CriteriaList": [drug, {
                "Criteria": {"ProcedureOccurrence": {"CodesetId": 5, "First": True, "CorrelatedCriteria": {
                    "Type": "ALL", "CriteriaList": [drug], "Groups": []}}},
                "StartWindow": until, "Occurrence": {"Type": 0, "Count": 3},
            }],
            "Groups": [{"Type": "ALL", "Groups": [], "CriteriaList": [drug, drug]}],
        },
        "QualifiedLimit": {"Type": "All"},
        "ExpressionLimit": {"Type": "First"},
        "InclusionRules": [{"name": "few drugs", "expression": {"Type": "ALL", "CriteriaList": [drug], "Groups": []}}],
    }
    few = Correlated(Criterion("drug_era", 6), 7, -40, max_count=2)
    want = C.CohortDefinition(
        9,
        (Criterion("condition_occurrence", 4, date_range=(datetime.date(2003, 7, 15), datetime.date(2009, 2, 28)),
                   record_types=(32020, 32817)), Criterion("death")),
        45, 10, "All",
        Group("ANY", (
            few,
            Correlated(Criterion("procedure_occurrence", 5, True, nested=Group("ALL", (few,))), -3, None, 3, 3),
            Group("ALL", (few, few)),
        )),
        "All", "First", (C.InclusionRule("few drugs", Group("ALL", (few,))),),
    )
    return spec, want


def test_definition_json(spark, tmp_path):
    spec, want = stored()
    assert C.definition_from_json(9, spec) == want
    assert C.definition_from_json(9, C.definition_to_json(want)) == want
    assert C.definition_from_json(1, C.definition_to_json(design.DEFINITIONS[1])) == design.DEFINITIONS[1]
    (tmp_path / "one.json").write_text(json.dumps(spec, indent=1))
    read = read_cohort_definitions(spark, str(tmp_path))
    wanted = {(4, 11, False, True), (4, 12, True, False)}
    assert {(r.codeset_id, r.concept_id, r.is_excluded, r.include_descendants) for r in definition_items(read).collect()} == wanted
    rows = {r.position: r for r in definition_criteria(read).collect()}
    assert (rows[0].domain, rows[0].codeset_id, rows[0].first_only, rows[0].record_types, rows[0].prior_days) == (
        "ConditionOccurrence", 4, False, [32020, 32817], 45)
    assert str(rows[0].range_end) == "2009-02-28" and rows[0].visit_types is None and rows[1].domain == "Death"


def test_definitions_as_rows_come_back_whole(spark, tmp_path):
    spec, want = stored()
    odd = {"a": [], "b": {}, "c": [[1, None], {"#0": "x"}, {"0": True}], "d/e~f": 1.5, "#1": "text"}
    for name, doc in (("one", spec), ("two", odd)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    nodes = definition_nodes(spark, str(tmp_path))
    back = {name.rsplit("/", 1)[-1]: doc for name, doc in documents(nodes).items()}
    assert back == {"one.json": spec, "two.json": odd}
    assert C.definition_from_json(9, back["one.json"]) == want
    items = {(r.codeset_id, r.concept_id, r.is_excluded, r.include_descendants) for r in node_items(nodes).collect()}
    assert items == {(4, 11, False, True), (4, 12, True, False)}
    deep = nodes.filter("path like 'AdditionalCriteria/%/CorrelatedCriteria/%CodesetId'").collect()
    assert [r.value for r in deep] == ["6"]


def test_rules_are_decided_together_and_counted_by_prefix(frame):
    masked = frame(
        [(1, 0, 1, 0b111), (1, 0, 2, 0b001), (2, 0, 3, 0b110), (3, 0, 4, 0b011), (3, 0, 5, 0b101), (4, 0, 6, 0b000)],
        "person_id long, source int, event_id long, inclusion_rule_mask long",
    )
    rules = tuple(C.InclusionRule(f"r{i}", Group("ALL", ())) for i in range(3))
    got = [tuple(r) for r in C.rule_attrition(masked, C.CohortDefinition(1, (), rules=rules)).orderBy("step").collect()]
    assert got == [(0, "qualified events", 4, 6), (1, "r0", 2, 4), (2, "r1", 2, 2), (3, "r2", 1, 1)]
    none = C.rule_attrition(masked.limit(0), C.CohortDefinition(1, (), rules=rules))
    assert [(r.persons, r.events) for r in none.collect()] == [(0, 0)] * 4


def test_steps_survived_counts_each_subject_with_its_furthest_row(frame):
    steps = [
        ("in", frame([(1, 10, 0), (1, 11, 0), (1, 11, 0), (2, 10, 0), (1, None, 0)], "arm int, s long, last int")),
        ("judged", frame([(1, 10, 1), (1, 10, 2), (1, 11, 1)], "arm int, s long, last int")),
        ("kept", None),
    ]
    got = sorted((r.arm, r.step, r.label, r.subjects) for r in C.steps_survived(steps, ["arm"], "s").collect())
    assert got == [(1, 0, "in", 3), (1, 1, "judged", 2), (1, 2, "kept", 1), (2, 0, "in", 1), (2, 1, "judged", 0), (2, 2, "kept", 0)]


@pytest.mark.parametrize("change", [
    {"InclusionRules": [{"name": "r"}]}, {"InclusionRules": [{"expression": {"Type": "AT_MOST", "CriteriaList": []}}]}, {"CensoringCriteria": [{}]}, {"EndStrategy": {"DateOffset": {}}},
    {"PrimaryCriteria": {"CriteriaList": [{"DrugEra": {"CodesetId": 1, "Age": {"Value": 18}}}]}},
    {"PrimaryCriteria": {"CriteriaList": [{"Measurement": {"CodesetId": 1}}]}},
    {"AdditionalCriteria": {"Type": "AT_LEAST", "CriteriaList": [], "Groups": []}},
    {"AdditionalCriteria": {"Type": "ALL", "CriteriaList": [], "DemographicCriteriaList": [{"Age": 1}]}},
])
def test_definition_parts_that_are_not_understood_fail(change):
    from twinarm.operators.cohorts import definition_from_json

    spec = {
        "PrimaryCriteria": {"CriteriaList": [{"DrugEra": {"CodesetId": 1}}]},
        "QualifiedLimit": {"Type": "All"},
        "ExpressionLimit": {"Type": "All"},
    }
    spec["PrimaryCriteria"] |= {"ObservationWindow": {"PriorDays": 0, "PostDays": 0}, "PrimaryCriteriaLimit": {"Type": "All"}}
    assert definition_from_json(1, spec).cohort_id == 1
    bad = spec | change
    bad["PrimaryCriteria"] = spec["PrimaryCriteria"] | change.get("PrimaryCriteria", {})
    with pytest.raises(ValueError, match="unsupported"):
        definition_from_json(1, bad)
