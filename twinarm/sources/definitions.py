"""Stored cohort definitions as rows: one row for each node of a document, whatever its depth.

Criteria nest without bound, which no Spark schema can state. So a document becomes a long table of its
values, named by their paths, which Spark can filter and join, and from which the document comes back.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``path``: keys and list places from the root, joined by ``/`` (in keys ``~`` is ``~0``, ``/`` is ``~1``
#: and ``#``, which marks list places, is ``~2``). ``kind``: ``value`` (JSON in ``value``), or ``list`` and ``object`` for empty ones.
NODES = "source_file string, path string, parent string, name string, kind string, value string"


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1").replace("#", "~2")


def _leaves(node, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    children = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else None
    if children is None:
        yield path, "value", json.dumps(node)
    elif not node:
        yield path, "object" if isinstance(node, dict) else "list", None
    else:
        for key, child in children:
            # A list place is marked, so that it is told from a key of digits.
            yield from _leaves(child, (*path, f"#{key}" if isinstance(node, list) else _escape(key)))


def _flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (name, "/".join(path), "/".join(path[:-1]), path[-1] if path else "", kind, value)
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for path, kind, value in _leaves(json.loads(text), ())
        ]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        names = [c.split()[0] for c in NODES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)


def definition_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All values of the cohort-definition JSON files below ``path``."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    return texts.mapInArrow(_flatten, NODES)


def documents(nodes: DataFrame) -> dict[str, dict]:
    """The documents behind the nodes, by file; a caller asks for those it builds cohorts from."""
    out: dict[str, dict] = {}
    for row in nodes.select("source_file", "path", "kind", "value").collect():
        value = json.loads(row.value) if row.kind == "value" else {} if row.kind == "object" else []
        tree = out.setdefault(row.source_file, {})
        parts = row.path.split("/")
        for part in parts[:-1]:
            tree = tree.setdefault(part, {})
        tree[parts[-1]] = value
    return {name: _assembled(tree) for name, tree in out.items()}


def _assembled(tree):
    if not isinstance(tree, dict) or not tree:
        return tree
    if all(k.startswith("#") for k in tree):
        return [_assembled(tree[k]) for k in sorted(tree, key=lambda k: int(k[1:]))]
    return {k.replace("~2", "#").replace("~1", "/").replace("~0", "~"): _assembled(v) for k, v in tree.items()}


def node_items(nodes: DataFrame) -> DataFrame:
    """Concept-set items among the nodes; a flag that is absent counts as false."""
    place = F.regexp_extract("path", "^ConceptSets/#([0-9]+)/expression/items/#([0-9]+)/(.*)$", 3)
    held = nodes.filter(F.col("path").rlike("^ConceptSets/#[0-9]+/"))

    def number(group: int) -> Column:
        return F.regexp_extract("path", "^ConceptSets/#([0-9]+)/(?:expression/items/#([0-9]+)/)?", group)

    def one(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("value")))

    sets = held.filter(F.col("path").rlike("^ConceptSets/#[0-9]+/id$")).select(
        "source_file", number(1).alias("s"), F.col("value").cast("int").alias("codeset_id"))
    items = held.filter(number(2) != "").groupBy("source_file", number(1).alias("s"), number(2).alias("i")).agg(
        one(place == "concept/CONCEPT_ID").cast("long").alias("concept_id"),
        F.coalesce(one(place == "isExcluded").cast("boolean"), F.lit(False)).alias("is_excluded"),
        F.coalesce(one(place == "includeDescendants").cast("boolean"), F.lit(False)).alias("include_descendants"),
    )
    return items.join(sets, ["source_file", "s"]).select("source_file", "codeset_id", "concept_id", "is_excluded", "include_descendants")
