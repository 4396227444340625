"""Queries on survival reports, Table 1, and sources and sinks."""

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import design
from checks.feature_queries import HISTORY, history_flags
from checks.model_queries import outcome_summary
from checks.registry import VIEWS, query
from checks.study_queries import (
    KEYS,
    MODEL,
    MODEL_SQL,
    age_table,
    exact_matched,
    grid,
    population,
    score_tables,
    six,
    six_sql,
)
from twinarm.operators import history as H
from twinarm.operators import survival as R
from twinarm.operators import table1 as T
from twinarm.operators.cohorts import cohort_from_definition, definition_from_json, definition_to_json
from twinarm.operators.demographics import age_groups
from twinarm.session import scratch_folder
from twinarm.sources import cdm as SRC
from twinarm.sources import sinks
from twinarm.sources.definitions import definition_nodes, documents, node_items

ARM_SQL = f"{MODEL_SQL}, treatment"


@query(
    "r1_km",
    f"""SELECT {ARM_SQL}, day, at_risk, events, round(survival, 6) AS survival FROM (
            SELECT *, product(1 - events / at_risk) OVER (PARTITION BY {ARM_SQL} ORDER BY day)
                   AS survival
            FROM (SELECT *, sum(leaving) OVER (PARTITION BY {ARM_SQL} ORDER BY day DESC) AS at_risk
                  FROM (SELECT {ARM_SQL}, survival_time AS day, count(*) AS leaving,
                               count(*) FILTER (outcome_count > 0) AS events
                        FROM population GROUP BY ALL))
            WHERE events > 0)""",
)
def km(study):
    return six(R.kaplan_meier(population(study)), ["survival"])


@query(
    "r2_followup",
    f"""SELECT *, round(sum(subjects) OVER (PARTITION BY {ARM_SQL} ORDER BY day DESC)
               / sum(subjects) OVER (PARTITION BY {ARM_SQL}), 6) AS share_followed
        FROM (SELECT {ARM_SQL}, time_at_risk AS day, count(*) AS subjects
              FROM population GROUP BY ALL)""",
)
def follow(study):
    return six(R.followup(population(study)), ["share_followed"])


@query(
    "r3_median_tar",
    f"""SELECT {MODEL_SQL}, median(time_at_risk) FILTER (treatment = 1) AS t_median_days,
               median(time_at_risk) FILTER (treatment = 0) AS c_median_days
        FROM population GROUP BY ALL""",
)
def median_days(study):
    return R.median_time_at_risk(population(study))


# --- Table 1 -------------------------------------------------------------------------------------

HISTORY_LABELS = {s: f"{d} history {s}" for s, d in HISTORY.items()}
SPECS = [
    T.CovariateSpec(1, "Age at index", "continuous"),
    T.CovariateSpec(2, "Age groups", "categorical"),
    T.CovariateSpec(3, "CHADS2", "continuous"),
    T.CovariateSpec(4, "CHADS2-VASc", "continuous"),
    T.CovariateSpec(5, "Days with diagnosis", "continuous"),
    *[T.CovariateSpec(i, n, "count") for i, n in enumerate(HISTORY_LABELS.values(), start=6)],
]


def scores(study):
    stored = None
    for label, table in score_tables(study).items():
        part = table.select(
            "cohort_definition_id",
            "subject_id",
            F.lit(label).alias("label"),
            F.col("score").cast("double").alias("score"),
        )
        stored = part if stored is None else stored.unionByName(part)
    rows = H.arm_rows(stored, grid(study))
    return H.with_after_match(rows, exact_matched(study), KEYS)


def bands(study):
    table = study.stage("cohort_agegroups", age_table).withColumn("label", F.lit("Age groups"))
    rows = H.arm_rows(table, grid(study)).withColumnRenamed("age_group", "category")
    return H.with_after_match(rows, exact_matched(study), KEYS)


def flags(study):
    """History flags once per comparison, then once per outcome for its matched population."""
    found = history_flags(
        study, design.comparisons(study), ["target_id", "comparator_id", "treatment"]
    )
    label = F.lit(None).cast("string")
    for codeset, name in HISTORY_LABELS.items():
        label = F.when(F.col("codeset_id") == codeset, F.lit(name)).otherwise(label)
    rows = found.withColumn("label", label).join(
        F.broadcast(grid(study)), ["target_id", "comparator_id"]
    )
    return H.with_after_match(rows, exact_matched(study), KEYS)


VIEWS["t1_scores"] = f"""
    SELECT {MODEL_SQL}, treatment, after_match, v.label, CAST(v.score AS DOUBLE) AS score
    FROM (SELECT DISTINCT {MODEL_SQL}, cohort_definition_id, treatment, subject_id, after_match
          FROM marked_arms)
    JOIN (SELECT 'Age at index' AS label, cohort_definition_id, subject_id, age_at_index AS score
          FROM ages
          UNION ALL SELECT 'CHADS2', cohort_definition_id, subject_id, score FROM chads2
          UNION ALL SELECT 'CHADS2-VASc', cohort_definition_id, subject_id, score FROM chads2vasc
          UNION ALL SELECT 'Days with diagnosis', cohort_definition_id, subject_id, score
                    FROM dx_history) v USING (cohort_definition_id, subject_id)"""
VIEWS["t1_bands"] = """
    SELECT 'Age groups' AS label, m.*, b.age_group AS category
    FROM marked_arms m JOIN age_bands b USING (cohort_definition_id, subject_id)"""
LABEL_SQL = " ".join(f"WHEN {s} THEN '{n}'" for s, n in HISTORY_LABELS.items())
VIEWS["t1_flags"] = f"""
    SELECT DISTINCT f.target_id, f.comparator_id, m.outcome_id, f.treatment, f.subject_id,
           m.after_match, f.score, CASE f.codeset_id {LABEL_SQL} END AS label
    FROM flags f JOIN marked_arms m USING (target_id, comparator_id, treatment, subject_id)"""
CELLS = {
    "t_before": "treatment = 1",
    "c_before": "treatment = 0",
    "t_after": "treatment = 1 AND after_match = 1",
    "c_after": "treatment = 0 AND after_match = 1",
}


def continuous_line(number, metric):
    """One line of the continuous block; NULL percentages, a difference on the mean only."""
    call = {"mean": "avg", "sd": "stddev_samp", "median": "median", "min": "min", "max": "max"}
    out = []
    for cell, keep in CELLS.items():
        out.append(f"{call[metric]}(score) FILTER ({keep}) AS {cell}_n")
        out.append(f"CAST(NULL AS DOUBLE) AS {cell}_pct")
    for stage in ("before", "after"):
        t, c = CELLS[f"t_{stage}"], CELLS[f"c_{stage}"]
        diff = "CAST(NULL AS DOUBLE)"
        if metric == "mean":
            diff = f"""round((avg(score) FILTER ({t}) - avg(score) FILTER ({c}))
                / nullif(sqrt((pow(stddev_samp(score) FILTER ({t}), 2)
                               + pow(stddev_samp(score) FILTER ({c}), 2)) / 2), 0), 3)"""
        out.append(f"{diff} AS {stage}_std_diff")
    return f"""SELECT {MODEL_SQL}, label, {number} AS line, '{metric}' AS characteristic,
        {", ".join(out)} FROM t1_scores GROUP BY {MODEL_SQL}, label"""


VIEWS["continuous_lines"] = " UNION ALL BY NAME ".join(
    continuous_line(i, m) for i, m in enumerate(T.METRICS, start=1)
)


def count_columns(hit, with_diff):
    out = []
    for cell, keep in CELLS.items():
        hits = f"count(*) FILTER ({keep} AND {hit})"
        total = f"sum(count(*) FILTER ({keep})) OVER (PARTITION BY {MODEL_SQL}, label)"
        out.append(f"CAST({hits} AS DOUBLE) AS {cell}_n")
        out.append(f"round({hits} / nullif({total}, 0) * 100, 3) AS {cell}_pct")
    for stage in ("before", "after"):
        part = {}
        for arm in "tc":
            keep = CELLS[f"{arm}_{stage}"]
            part[arm] = (
                f"count(*) FILTER ({keep})",
                f"sum(count(*) FILTER ({keep})) OVER (PARTITION BY {MODEL_SQL}, label)",
            )
        (ht, nt), (hc, nc) = part["t"], part["c"]
        n, p = f"({nt} + {nc})", f"(({ht} + {hc}) / nullif({nt} + {nc}, 0))"
        diff = f"""round(({hc} / nullif({nc}, 0) - {ht} / nullif({nt}, 0))
            / nullif(sqrt({n} * {p} * (1 - {p}) / ({n} - 1)), 0), 3)"""
        out.append(f"{diff if with_diff else 'CAST(NULL AS DOUBLE)'} AS {stage}_std_diff")
    return ", ".join(out)


VIEWS["categorical_lines"] = f"""
    SELECT {MODEL_SQL}, label, 1 AS line, category AS characteristic, {count_columns("true", True)}
    FROM t1_bands GROUP BY {MODEL_SQL}, label, category"""
VIEWS["count_lines"] = f"""
    SELECT {MODEL_SQL}, label, 1 AS line, label AS characteristic,
           {count_columns("score = 1", False)}
    FROM t1_flags GROUP BY {MODEL_SQL}, label"""
NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in T.VALUE_COLUMNS)
POSITION_SQL = "CASE label " + " ".join(f"WHEN '{s.label}' THEN {s.position}" for s in SPECS)
VIEWS["table_one"] = f"""
    SELECT {MODEL_SQL}, {POSITION_SQL} END AS position, line, characteristic,
           {", ".join(f"CAST(round(CAST({c} AS DECIMAL(28, 12)), 2) AS DOUBLE) AS {c}"
                       for c in T.VALUE_COLUMNS)}
    FROM (SELECT * FROM continuous_lines UNION ALL BY NAME SELECT * FROM categorical_lines
          UNION ALL BY NAME SELECT * FROM count_lines
          UNION ALL BY NAME SELECT DISTINCT {MODEL_SQL}, label, 0 AS line,
                                   label AS characteristic, {NULLS}
                    FROM (SELECT {MODEL_SQL}, label FROM t1_scores
                          UNION ALL SELECT {MODEL_SQL}, label FROM t1_bands))"""


@query(
    "t1_continuous",
    f"""SELECT {MODEL_SQL}, label, line, characteristic, {six_sql(T.VALUE_COLUMNS)}
        FROM continuous_lines""",
)
def continuous(study):
    return six(T.continuous_block(scores(study), [*KEYS, "label"]), T.VALUE_COLUMNS)


@query(
    "t2_continuous_std_diff",
    f"""SELECT {MODEL_SQL}, label, before_std_diff, after_std_diff
        FROM continuous_lines WHERE line = 1""",
)
def continuous_diff(study):
    return (
        T.continuous_block(scores(study), [*KEYS, "label"])
        .filter("line = 1")
        .select(*MODEL, "label", "before_std_diff", "after_std_diff")
    )


@query(
    "t3_categorical_std_diff",
    f"""SELECT {MODEL_SQL}, characteristic AS category, before_std_diff, after_std_diff
        FROM categorical_lines""",
)
def categorical_diff(study):
    return T.categorical_block(bands(study), [*KEYS, "label"]).select(
        *MODEL, "category", "before_std_diff", "after_std_diff"
    )


@query(
    "t4_t6_counts",
    f"SELECT {MODEL_SQL}, label, {', '.join(T.VALUE_COLUMNS)} FROM count_lines",
)
def counts(study):
    return T.count_block(flags(study), [*KEYS, "label"])


@query(
    "t5_categorical",
    f"""SELECT {MODEL_SQL}, label, characteristic AS category, {', '.join(T.VALUE_COLUMNS)}
        FROM categorical_lines""",
)
def categorical(study):
    return T.categorical_block(bands(study), [*KEYS, "label"])


@query("t7_table1", "SELECT * FROM table_one")
def table_one(study):
    return T.table1(SPECS, scores(study), bands(study), flags(study), KEYS)


# --- sources and sinks ---------------------------------------------------------------------------


def folder(study, name):
    application = study.spark.sparkContext.applicationId
    scale = study.sf_dir.rstrip("/").rsplit("/", 1)[-1]
    return f"{scratch_folder(study.spark)}/sinks/{application}/{scale}/{name}"


@query(
    "s1_read_cdm",
    """SELECT condition_concept_id, count(*) AS records, min(condition_start_date) AS first_date
       FROM condition_occurrence GROUP BY condition_concept_id""",
)
def read_cdm(study):
    root = folder(study, "store")
    sinks.replace_table(study.cdm["condition_occurrence"], f"{root}/condition_occurrence")
    table = SRC.open_cdm(study.spark, root)["condition_occurrence"]
    return table.groupBy("condition_concept_id").agg(
        F.count("*").alias("records"), F.min("condition_start_date").alias("first_date")
    )


@query(
    "s2_concept_lists",
    """SELECT concept_id FROM codesets WHERE codeset_id IN (28, 36)
       UNION ALL SELECT concept_id FROM codesets WHERE codeset_id = 36""",
)
def concept_lists(study):
    """Lists written as CSV files and read back as one folder; repeated ids stay repeated."""
    path = folder(study, "lists")
    ids = design.codesets(study).select(F.col("concept_id").alias("CONCEPT_ID"), "codeset_id")
    first = ids.filter("codeset_id in (28, 36)").select("CONCEPT_ID")
    first.write.mode("overwrite").option("header", True).csv(path)
    ids.filter("codeset_id = 36").select("CONCEPT_ID").write.mode("append").option(
        "header", True
    ).csv(path)
    return SRC.read_concept_lists(study.spark, path)


@query(
    "s4_replace_cohort",
    """SELECT cohort_definition_id, subject_id, cohort_start_date, cohort_end_date FROM arm_b
       UNION ALL SELECT * FROM arm_a WHERE subject_id % 2 = 0""",
)
def replace_cohort(study):
    """Fill cohorts 1 and 2, replace 1 by fewer rows, and clear 3."""
    path = folder(study, "cohort")
    arms = design.arms(study)
    for cohort_id in (1, 2, 3):
        sinks.replace_cohort(arms, path, cohort_id)
    sinks.replace_cohort(arms.filter("subject_id % 2 = 0"), path, 1)
    sinks.replace_cohort(arms.filter(F.lit(False)), path, 3)
    return sinks.read_cohorts(study.spark, path)


@query("s5_replace_table", "SELECT * FROM age_bands")
def replace_table(study):
    path = folder(study, "agegroups")
    for _ in range(2):
        sinks.replace_table(age_groups(design.arms(study), study.cdm["person"]), path)
    return study.spark.read.parquet(path)


@query(
    "s6_matched_cohorts",
    f"""SELECT {MODEL_SQL}, CASE WHEN treatment = 1 THEN target_id ELSE comparator_id END
               AS cohort_definition_id, subject_id, cohort_start_date, cohort_end_date
        FROM matched""",
)
def matched_cohorts(study):
    path = folder(study, "matched")
    sinks.write_matched(exact_matched(study), path)
    return study.spark.read.parquet(path).select(
        *[F.col(k).cast("long").alias(k) for k in MODEL],
        "cohort_definition_id",
        "subject_id",
        "cohort_start_date",
        "cohort_end_date",
    )


def stored_definitions(study):
    """The study's definitions with their concept sets as JSON files, one for each cohort."""
    path = folder(study, "definitions")
    docs = []
    for definition in design.DEFINITIONS.values():
        sets: dict = {}
        for codeset, concept, excluded, below in design.ITEMS:
            item = {"concept": {"CONCEPT_ID": concept}, "isExcluded": excluded}
            sets.setdefault(codeset, []).append(item | ({"includeDescendants": True} if below else {}))
        spec = definition_to_json(definition) | {
            "name": f"Cohort {definition.cohort_id}",
            "ConceptSets": [{"id": k, "name": f"set {k}", "expression": {"items": v}} for k, v in sets.items()],
        }
        docs.append((json.dumps(spec), definition.cohort_id))
    stored = study.spark.createDataFrame(docs, "value string, cohort_id int").repartition(len(docs), "cohort_id")
    stored.write.mode("overwrite").partitionBy("cohort_id").text(path)
    return definition_nodes(study.spark, path)


@query(
    "s3_definitions",
    "SELECT * FROM arms UNION ALL SELECT * FROM outcomes",
)
def definitions(study):
    """Cohorts built from definitions that were stored, flattened to rows and put together again."""
    parts = []
    for name, spec in documents(stored_definitions(study)).items():
        cohort_id = int(re.search(r"cohort_id=(\d+)", name).group(1))
        parts.append(cohort_from_definition(study.cdm, design.codesets(study), definition_from_json(cohort_id, spec)))
    return reduce(DataFrame.unionByName, parts)


@query(
    "v8_items",
    f"""SELECT codeset_id, concept_id, is_excluded, include_descendants, {len(design.DEFINITIONS)} AS definitions,
               (SELECT count(*) FROM concept c WHERE c.concept_id = i.concept_id) AS known FROM items i""",
)
def json_items(study):
    """Items of the concept sets of all stored definitions, with what the vocabulary knows of them."""
    items = node_items(stored_definitions(study)).groupBy("codeset_id", "concept_id", "is_excluded", "include_descendants").agg(
        F.count("*").cast("int").alias("definitions"))
    concepts = study.cdm["concept"].groupBy("concept_id").agg(F.count("*").alias("known"))
    return items.join(concepts, "concept_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))


@query(
    "s7_stage_artefact",
    "SELECT treatment, subject_id, time_at_risk FROM population WHERE target_id = 2 AND outcome_id = 12",
)
def stage_artefact(study):
    path = folder(study, "strat_pop")
    sinks.write_stage(population(study), path, MODEL, "1")
    # A second analysis in the same folder, and one that is run again with a smaller grid.
    sinks.write_stage(population(study).withColumn("time_at_risk", F.lit(0)), path, MODEL, "2")
    return sinks.read_stage(study.spark, path, "1", target_id=2, outcome_id=12).select(
        "treatment", "subject_id", "time_at_risk"
    )


@query(
    "s7_rerun_with_a_smaller_grid",
    f"""SELECT '1' AS analysis_id, {MODEL_SQL}, count(*) AS subjects FROM population WHERE outcome_id = 12 GROUP BY ALL
        UNION ALL SELECT '2', {MODEL_SQL}, count(*) FROM population GROUP BY ALL""",
)
def smaller_grid(study):
    path = folder(study, "reruns")
    sinks.write_stage(population(study), path, MODEL, "1")
    sinks.write_stage(population(study), path, MODEL, "2")
    sinks.write_stage(population(study).filter("outcome_id = 12"), path, MODEL, "1")
    parts = [
        sinks.read_stage(study.spark, path, a).groupBy(F.lit(a).alias("analysis_id"), *MODEL).agg(F.count("*").alias("subjects"))
        for a in ("1", "2")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "s8_report",
    f"""SELECT 't' || target_id || '_c' || comparator_id AS sheet, outcome_id, treated, comparator
        FROM outcome_summary""",
)
def report(study):
    path = folder(study, "report")
    sheet = F.concat(F.lit("t"), "target_id", F.lit("_c"), "comparator_id")
    sinks.write_report(outcome_summary(study).withColumn("sheet", sheet), path, "sheet")
    return study.spark.read.option("header", True).csv(path).select(
        "sheet",
        *[F.col(c).cast("long").alias(c) for c in ("outcome_id", "treated", "comparator")],
    )
