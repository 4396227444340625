from pyspark.sql import functions as F

from twinarm.operators import families as X
from twinarm.operators import history as H
from twinarm.operators import scores as S
from twinarm.operators.demographics import age_band, age_groups

COHORT = "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"
PERSON = "person_id long, year_of_birth int, gender_concept_id int"
ERAS = "person_id long, condition_concept_id long, condition_era_start_date date"


def test_age_bands(frame):
    ages = [-1, 0, 4, 5, 74, 75, 99, 100, None]
    got = [r[0] for r in frame([(a,) for a in ages], "age int").select(age_band(F.col("age"))).collect()]
    assert got == [f"Age Group {x}" for x in
                   ("100+", "0-4", "0-4", "5-9", "70-74", "75-79", "95-99", "100+", "100+")]


def test_repeated_entries_count_once(frame):
    cohort = frame([(1, 1, "2000-01-01", "2001-01-01")] * 2, COHORT)
    assert age_groups(cohort, frame([(1, 1950, 8507)], PERSON)).count() == 1


def test_scores(frame):
    cohort = frame([(1, p, "2000-06-01", "2001-01-01") for p in range(1, 6)], COHORT)
    person = frame([(1, 1940, 8507), (2, 1940, 8507), (3, 1940, 8507), (4, 1925, 8532), (5, 1940, 8507)], PERSON)
    eras = frame(
        [
            (2, 99, "1999-01-01"),  # unrelated
            (3, 10, "1999-01-01"), (3, 11, "1999-02-01"),  # one category twice
            (3, 12, "2000-06-01"),  # on index
            (5, 12, "2000-06-02"),  # after index
        ],
        ERAS,
    )
    categories = frame([(1, 1, 10), (1, 1, 11), (5, 2, 12)], "category_id int, weight int, concept_id long")

    def run(rules, **options):
        out = S.weighted_score(cohort, eras, person, categories, rules, **options).collect()
        return {r.subject_id: r.score for r in out}

    assert run(S.CHADS2_DEMOGRAPHICS, keep_any_history=True) == {2: 0, 3: 3, 4: 1}
    assert run(S.CHADS2VASC_DEMOGRAPHICS) == {3: 3, 4: 3}
    assert run((), include_zero=True) == {1: 0, 2: 0, 3: 3, 4: 0, 5: 0}


def test_highest_grade_of_each_category_counts(frame):
    cohort = frame([(1, p, "2000-06-01", "2001-01-01") for p in range(1, 8)] + [(2, 1, "1999-03-01", "2001-01-01")], COHORT)
    eras = frame(
        [
            (1, 10, "1999-01-01"), (1, 11, "1999-06-01"), (1, 11, "1999-07-01"),  # both grades of one category
            (2, 10, "2000-06-01"), (2, 12, "1990-01-01"),  # two categories, one on index
            (3, 11, "2000-06-02"),  # after index
            (4, 10, "1999-01-01"),  # a laboratory value of the same category raises it
            (5, 99, "1999-01-01"),  # unrelated
        ],
        ERAS,
    )
    grades = frame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "category_id int, grade int, concept_id long")
    measured = frame(
        [
            (4, 70, "1999-01-01", 9.5),
            (5, 70, "1999-01-01", 9.0), (5, 71, "1999-01-01", 5.0),  # on the limit; below the other one
            (6, 70, "1999-01-01", None), (6, 70, "1999-01-01", float("nan")), (6, 71, "1999-01-01", 6.0),
            (7, 70, "2000-06-02", 99.0),  # after index
        ],
        "person_id long, measurement_concept_id long, measurement_date date, value_as_number double",
    )
    limits = frame([(1, 2, 70, None, 9.0), (3, 1, 71, 6.0, 8.0)],
                   "category_id int, grade int, concept_id long, low double, high double")

    def run(*more):
        return {(r.cohort_definition_id, r.subject_id): r.score for r in S.graded_score(cohort, eras, grades, *more).collect()}

    assert run() == {(1, 1): 2, (2, 1): 1, (1, 2): 2, (1, 4): 1}
    assert run(measured, limits) == {(1, 1): 2, (2, 1): 1, (1, 2): 2, (1, 4): 2, (1, 5): 1}
    assert run(measured.limit(0), limits.limit(0)) == run()
    assert S.graded_score(cohort, eras.limit(0), grades, measured.limit(0), limits).count() == 0


def test_days_and_flags(frame):
    cohort = frame(
        [(1, 1, "2000-01-01", "2002-01-01"), (1, 1, "2000-03-01", "2002-01-01"), (1, 2, "2000-01-01", "2002-01-01")],
        COHORT,
    )
    first = frame([(1, 1, "2000-01-01"), (1, 2, "2000-01-01")], "codeset_id int, person_id long, first_date date")
    days = H.days_since_first(cohort, first.select("person_id", "first_date")).collect()
    assert [(r.subject_id, r.score) for r in days] == [(1, 60)]
    rows = cohort.withColumn("treatment", F.lit(1)).withColumn("codeset_id", F.lit(1))
    flags = {(r.subject_id, r.score) for r in H.history_flag(rows, first, ["treatment"]).collect()}
    assert flags == {(1, 0), (1, 1), (2, 0)}


def test_rare_excluded_and_listed(frame):
    entry = "cohort_definition_id long, subject_id long, cohort_start_date date, " \
        "covariate_id long, covariate_value double"
    rows = [(1, s, "2000-01-01", c, 1.0) for c, n in ((5101, 3), (6101, 2), (8507001, 3)) for s in range(n)]
    cov = frame(rows, entry)
    ids = lambda df: {r.covariate_id for r in df.select("covariate_id").distinct().collect()}
    pairs = frame([(1, 2)], "target_id long, comparator_id long")
    assert ids(X.drop_rare(cov, pairs, 3)) == {5101, 8507001}
    # Two targets with 3 subjects each do not make one comparison with 6.
    two = frame([(t, 10 * t + k, "2000-01-01", 9101, 1.0) for t in (1, 3) for k in range(3)], entry)
    pairs = frame([(1, 2), (3, 2)], "target_id long, comparator_id long")
    assert X.drop_rare(two, pairs, 4).isEmpty()
    # Interactions of an excluded concept go with it.
    by_year = X.year_interaction(cov)
    gone = frame([(5,)], "concept_id long")
    none = frame([], "ancestor_concept_id long, descendant_concept_id long")
    left = X.exclude_concepts(by_year, gone, none).select(X.base_covariate(F.col("covariate_id")).alias("covariate_id"))
    assert ids(left) == {6101, 8507001}
    ancestor = frame([(4, 5)], "ancestor_concept_id long, descendant_concept_id long")
    assert ids(X.exclude_concepts(cov, frame([(4,), (8507,)], "concept_id long"), ancestor)) == {6101, 8507001}
    assert ids(X.drop_listed(cov, frame([(6101,)], "covariate_id long"))) == {5101, 8507001}
