"""Registry of the checked queries and of the SQL views their oracles share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.adapter import CDM_VIEWS, retail_cdm
from twinarm.session import partitions_for, scratch_folder, tune
from twinarm.sources.cdm import Cdm

VIEWS: dict[str, str] = dict(CDM_VIEWS)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STAGES: dict[tuple, DataFrame] = {}
_STUDIES: dict[tuple, Study] = {}
#: Tables that grow with the persons and their records.
LARGE = ("customer", "orders", "lineitem", "part", "events")


class Study:
    """Tables of one scale directory plus the stages already materialised in this application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.partitions = partitions_for(spark, [f"{sf_dir}/{table}.parquet" for table in LARGE])
        self.sf_dir = sf_dir
        self.cdm: Cdm = retail_cdm(spark, sf_dir, self._store)
        self.built: dict[str, DataFrame] = {}

    def _store(
        self, name: str, build: Callable[[], DataFrame], by: list[str] | None = None
    ) -> DataFrame:
        application = self.spark.sparkContext.applicationId
        key = (application, self.sf_dir, name)
        if key not in _STAGES:
            scale = self.sf_dir.rstrip("/").rsplit("/", 1)[-1]
            path = f"{scratch_folder(self.spark)}/stages/{application}/{scale}/{name}"
            build().write.mode("overwrite").option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
            _STAGES[key] = self.spark.read.parquet(path)
        return _STAGES[key]

    def stage(self, name: str, build: Callable[[Study], DataFrame]) -> DataFrame:
        """A stage table, written once per application as the original stores its artefacts."""
        return self._store(name, lambda: build(self))


def study_for(spark: SparkSession, sf_dir: str) -> Study:
    """One ``Study`` per application and scale directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, sf_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", _STUDIES[key].partitions)
    return _STUDIES[key]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any view of ``VIEWS`` as if it were a table."""

    def register(fn: Callable[[Study], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(study_for(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def expand(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str, known: list[str]) -> None:
        for view in known:
            if view not in needed and re.search(rf"\b{view}\b", text):
                needed.add(view)
                visit(VIEWS[view], known[: known.index(view)])

    names = list(VIEWS)
    visit(sql, names)
    if not needed:
        return sql
    views = ",\n".join(
        f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in names if name in needed
    )
    recursive = re.match(r"\s*WITH RECURSIVE\b", sql)
    if recursive:
        return f"WITH RECURSIVE {views},\n{sql[recursive.end():]}"
    return f"WITH {views}\n{sql}"
