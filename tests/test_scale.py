"""Plans and results with one key that holds a third of the rows."""

from pyspark.sql import functions as F

from checks import registry
from twinarm import session
from twinarm.operators.events import in_observation
from twinarm.operators.families import _daily, _windowed
from twinarm.session import small_side


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def with_settings(spark, settings, run):
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "30KB",
    "spark.sql.shuffle.partitions": "8",
}


def hot_events(spark):
    person = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 3001)
    return spark.range(0, 60000, 1, 8).select(
        person.alias("person_id"),
        F.col("id").alias("event_id"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("start_date"),
        (F.col("id") % 40).alias("concept_id"),
    )


def test_hot_person_is_split_in_the_observation_join(spark):
    periods = spark.range(3001).select(
        F.col("id").alias("person_id"),
        F.lit("2000-01-01").cast("date").alias("observation_period_start_date"),
        F.lit("2003-01-01").cast("date").alias("observation_period_end_date"),
    )
    joined = in_observation(hot_events(spark), periods)
    text = with_settings(spark, SMALL_SKEW, lambda: plan(joined))
    assert "skew=true" in text
    assert joined.count() == 60000


def test_hot_person_is_split_before_a_window_aggregate(spark):
    cohort = spark.range(3001).select(
        F.lit(1).cast("long").alias("cohort_definition_id"),
        F.col("id").alias("subject_id"),
        F.lit("2001-06-01").cast("date").alias("cohort_start_date"),
    )
    daily = _daily(hot_events(spark), "concept_id", "start_date")
    out = _windowed(cohort, daily, {"condition_long": 180, "condition_short": 30})
    hot = out.filter("subject_id = 7").count()
    whole = with_settings(spark, SMALL_SKEW, lambda: out.collect())
    assert sum(1 for r in whole if r.subject_id == 7) == hot > 0


def test_small_side_broadcasts_only_below_its_bound(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = spark.range(500).withColumnRenamed("id", "k")

    def check():
        assert "BroadcastHashJoin" in plan(left.join(small_side(right, 500), "k"))
        assert "BroadcastHashJoin" not in plan(left.join(small_side(right, 499), "k"))

    with_settings(
        spark,
        {"spark.sql.autoBroadcastJoinThreshold": "-1"},
        check,
    )


def test_shuffles_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """A task takes no more rows because the tables are larger: ten times the rows, ten times the partitions."""
    named, asked = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    small, large = (str(tmp_path / f"{n}.parquet") for n in ("small", "large"))
    spark.range(20_000).coalesce(1).write.parquet(small)
    spark.range(200_000).repartition(3).write.parquet(large)
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    assert session.partitions_for(spark, [small]) >= asked
    assert session.partitions_for(spark, [large]) > 4 * session.partitions_for(spark, [small])
    before = spark.conf.get(named, None)
    folder = "/root/testdata/sf0.001"
    monkeypatch.delitem(registry._STUDIES, (spark.sparkContext.applicationId, folder), raising=False)
    try:
        assert registry.study_for(spark, folder).partitions == int(spark.conf.get(named)) > asked
    finally:
        spark.conf.unset(named) if before is None else spark.conf.set(named, before)
        registry._STUDIES.pop((spark.sparkContext.applicationId, folder), None)
