"""Concept-set queries."""

from pyspark.sql import functions as F

from checks import design
from checks.registry import query
from twinarm.operators.concept_sets import (
    concept_set_items,
    descendants,
    resolve_concept_sets,
    resolve_one,
    standard_descendants,
    valid_only,
)


@query(
    "v1_explicit_valid",
    """SELECT i.codeset_id, i.concept_id FROM items i JOIN concept c USING (concept_id)
       WHERE NOT i.is_excluded AND c.invalid_reason IS NULL""",
)
def explicit_valid(study):
    listed = design.items(study).filter("not is_excluded").select("codeset_id", "concept_id")
    return valid_only(listed, study.cdm["concept"])


@query(
    "v2_descendants_valid",
    """SELECT DISTINCT i.codeset_id, c.concept_id FROM items i
       JOIN concept_ancestor x ON x.ancestor_concept_id = i.concept_id
       JOIN concept c ON c.concept_id = x.descendant_concept_id
       WHERE i.include_descendants AND c.invalid_reason IS NULL""",
)
def descendants_valid(study):
    listed = design.items(study).filter("include_descendants").select("codeset_id", "concept_id")
    below = descendants(listed, study.cdm["concept_ancestor"])
    return valid_only(below, study.cdm["concept"]).distinct()


@query(
    "v3_include_set",
    "SELECT codeset_id, concept_id FROM covered WHERE codeset_id = 282 AND NOT is_excluded",
)
def include_set(study):
    wanted = [i for i in design.ITEMS if i[0] == 282]
    return resolve_concept_sets(
        concept_set_items(study.spark, wanted),
        study.cdm["concept"],
        study.cdm["concept_ancestor"],
    )


@query("v4_exclude_set", "SELECT codeset_id, concept_id FROM codesets WHERE codeset_id = 35")
def exclude_set(study):
    wanted = [i for i in design.ITEMS if i[0] == 35]
    return resolve_concept_sets(
        concept_set_items(study.spark, wanted),
        study.cdm["concept"],
        study.cdm["concept_ancestor"],
    )


@query("v5_codesets", "SELECT codeset_id, concept_id FROM codesets")
def all_codesets(study):
    return design.resolve(study)


@query(
    "v6_descendants_any",
    """SELECT DISTINCT i.codeset_id, x.descendant_concept_id AS concept_id FROM items i
       JOIN concept_ancestor x ON x.ancestor_concept_id = i.concept_id
       WHERE i.codeset_id BETWEEN 501 AND 506""",
)
def descendants_any(study):
    listed = design.items(study).filter("codeset_id between 501 and 506")
    return descendants(
        listed.select("codeset_id", "concept_id"), study.cdm["concept_ancestor"]
    ).distinct()


@query(
    "v7_standard_descendants",
    """SELECT DISTINCT c.concept_id FROM concept_ancestor x
       JOIN concept c ON c.concept_id = x.descendant_concept_id AND c.standard_concept = 'S'
       JOIN items i ON i.concept_id = x.ancestor_concept_id
       WHERE i.codeset_id IN (28, 29, 36)""",
)
def standard_below(study):
    ids = design.items(study).filter(F.col("codeset_id").isin(28, 29, 36)).select("concept_id")
    return standard_descendants(ids, study.cdm["concept"], study.cdm["concept_ancestor"])


@query("v9_resolve_one", "SELECT concept_id FROM codesets WHERE codeset_id = 29")
def one_set(study):
    return resolve_one(design.codesets(study), 29)
