"""Documents made ready for training: known languages, good quality, no near copies, no benchmark
passages, packed into sequences. Each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinarm.llm import decontaminate, language, near_text, packing, quality
from twinarm.llm.queries import language_model, quality_model
from twinarm.llm.storage import read_table, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Similarity of near copies in the corpus; op8 has a threshold of its own by its contract.
NEAR = (80, 100)

#: The classifiers and the approximate optimum of the packing have no SQL form.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts unlike every learned language."""
    return language.known_rows(docs, language_model(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold of the classifier."""
    return quality.good_rows(docs, quality_model(docs, read_table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all documents of a class of near copies but the one with the smallest id."""
    return near_text.one_of_each(docs, similarity=NEAR)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark passages."""
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
