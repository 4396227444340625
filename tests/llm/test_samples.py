"""What is sampled, and from what, before a model is fitted."""

from pyspark.sql import functions as F

from tests.llm import odd
from twinarm.llm import quality, queries


def seen(monkeypatch):
    rows = {}
    monkeypatch.setattr(quality, "train", lambda df: rows.update(df=df) or "model")
    return rows


def test_only_sampled_ids_meet_the_texts(spark, monkeypatch):
    rows = seen(monkeypatch)
    monkeypatch.setattr(quality, "SAMPLE", 200)
    docs = odd.docs(spark, [(i, f"text {i}") for i in range(3000)])
    labels = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert queries.quality_model(docs, labels) == "model"
    found = rows["df"].select("doc_id", "text", "quality").collect()
    # From the labels that have a document and are no held-out ones; the labels of others take no place.
    assert 140 < len(found) < 270
    assert all(r.text == f"text {r.doc_id}" and r.quality == r.doc_id % 2 for r in found)
    folds = docs.select("doc_id", queries._fold(4).alias("fold")).collect()
    assert not {r.doc_id for r in folds if r.fold == 2} & {r.doc_id for r in found}


def test_odd_labels_teach_nothing(spark, monkeypatch):
    rows = seen(monkeypatch)
    docs = odd.docs(spark, [(1, "a"), (3, "b"), (3, "b"), (4, None), (None, "c"), (5, "d"), (6, "e")])
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (3, 1), (3, 1), (4, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    queries.quality_model(docs, labels)
    found = sorted((r.doc_id, r.text, r.quality) for r in rows["df"].collect() if r.doc_id != 4)
    open_ids = {r.doc_id for r in docs.where(queries._fold(4) != 2).collect()}
    assert found == [r for r in [(3, "b", 1), (3, "b", 1)] if r[0] in open_ids]
    queries.quality_model(docs.limit(0), labels)
    assert rows["df"].count() == 0


def test_copies_of_a_row_teach_once(spark):
    lines = [(i, "good words in a line.") for i in range(30)] + [(i, "bad*** bad*** bad***") for i in range(30, 60)]
    mark = F.col("doc_id") < 30
    once = odd.docs(spark, lines).withColumn("quality", mark.cast("int"))
    often = odd.docs(spark, lines + lines[:1] * 500).withColumn("quality", mark.cast("int"))
    tested = odd.docs(spark)
    got = [[r.score for r in quality.predict(tested, quality.train(d)).orderBy("id").collect()] for d in (once, often)]
    assert got[0] == got[1]
