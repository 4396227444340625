"""The driver's retail tables seen as patient-event tables, in Spark and as SQL views.

Both forms use integer arithmetic only, so the two engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinarm.sources.cdm import Cdm

TYPES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
ERA_GAP_DAYS = 30
# Type indexes of the domains.
DOMAIN_TYPES = {"procedure": [2], "condition": [3, 5], "drug": [1, 4, 6]}


def retail_cdm(
    spark: SparkSession,
    sf_dir: str,
    stage: Callable[[str, Callable[[], DataFrame], list[str]], DataFrame] | None = None,
) -> Cdm:
    """``stage`` stores what a patient-event store would hold ready: records, eras, periods."""

    def staged(name: str, build: Callable[[], DataFrame], by: list[str]) -> DataFrame:
        return build() if stage is None else stage(name, build, by)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def parts() -> DataFrame:
        kind = F.lit(None).cast("int")
        for label, index in TYPES.items():
            kind = F.when(F.col("p_type") == label, F.lit(index)).otherwise(kind)
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        return read("part").select(
            "p_partkey",
            "p_size",
            kind.alias("t"),
            (10000 + 100 * kind + brand).cast("long").alias("brand_id"),
        )

    def records() -> DataFrame:
        lines = read("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.to_date("l_shipdate").alias("start_date"),
            F.when(
                F.col("l_returnflag") != "N",
                F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") % 14),
            ).alias("end_date"),
            F.when(F.col("l_linestatus") == "F", 38000184).otherwise(38000230).alias("type_id"),
        )
        orders = read("orders").select("o_orderkey", "o_custkey")
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        joined = lines.join(parts(), F.col("l_partkey") == F.col("p_partkey")).join(
            orders, F.col("l_orderkey") == F.col("o_orderkey")
        )
        return (
            joined.groupBy(*keys, "o_custkey", "t", "brand_id")
            .agg(
                F.min("start_date").alias("start_date"),
                F.min("end_date").alias("end_date"),
                F.min("type_id").alias("type_id"),
            )
            .withColumnRenamed("o_custkey", "person_id")
        )

    def base(types: list[int]) -> DataFrame:
        # Ids made of the keys are made on reading: stored, they would be a third of the table.
        return staged("records", records, ["t"]).filter(F.col("t").isin(types)).select(
            (
                ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey"))
                * 10000
                + F.col("l_suppkey")
            ).alias("occ_id"),
            "person_id",
            F.col("l_orderkey").alias("visit_occurrence_id"),
            (F.lit(1000000) + F.col("l_partkey")).alias("concept_id"),
            "l_partkey",
            "l_suppkey",
            "t",
            "brand_id",
            "start_date",
            "end_date",
            "type_id",
        )

    def eras(domain: str) -> DataFrame:
        # Dealt once, by person and brand, for the days, the window and the eras. One row per person, brand
        # and day first: the window then holds calendar days only.
        days = (
            base(DOMAIN_TYPES[domain])
            .select(
                "person_id",
                "brand_id",
                "start_date",
                F.coalesce("end_date", F.date_add("start_date", 1)).alias("end_date"),
            )
            .repartition("person_id", "brand_id")
            .groupBy("person_id", "brand_id", "start_date")
            .agg(F.max("end_date").alias("end_date"))
        )
        by_start = Window.partitionBy("person_id", "brand_id").orderBy("start_date")
        reached = F.max("end_date").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        starts = days.withColumn(
            "opens",
            F.when(F.col("start_date") <= F.date_add(reached, ERA_GAP_DAYS), 0).otherwise(1),
        )
        numbered = starts.withColumn("era", F.sum("opens").over(by_start))
        return (
            numbered.groupBy("person_id", "brand_id", "era")
            .agg(F.min("start_date").alias("s"), F.max("end_date").alias("e"))
            .select(
                (F.col("brand_id") * 1000 + F.col("era")).alias(f"{domain}_era_id"),
                "person_id",
                F.col("brand_id").alias(f"{domain}_concept_id"),
                F.col("s").alias(f"{domain}_era_start_date"),
                F.col("e").alias(f"{domain}_era_end_date"),
            )
        )

    def concept() -> DataFrame:
        p = parts()
        leaf = p.select(
            (F.lit(1000000) + F.col("p_partkey")).alias("concept_id"),
            F.when(F.col("p_size") == 50, "D").alias("invalid_reason"),
            F.lit("S").alias("standard_concept"),
        )
        none = F.lit(None).cast("string")
        brand = p.select(
            F.col("brand_id").alias("concept_id"),
            none.alias("invalid_reason"),
            F.lit("S").alias("standard_concept"),
        )
        kind = p.select(
            (100 + F.col("t")).cast("long").alias("concept_id"),
            none.alias("invalid_reason"),
            none.alias("standard_concept"),
        )
        return leaf.unionByName(brand.distinct()).unionByName(kind.distinct())

    def concept_ancestor() -> DataFrame:
        p = parts().select(
            (F.lit(1000000) + F.col("p_partkey")).alias("leaf"),
            "brand_id",
            (100 + F.col("t")).cast("long").alias("type_id"),
        )
        edges = [
            p.select("leaf", "leaf"),
            p.select("brand_id", "leaf"),
            p.select("type_id", "leaf"),
            p.select("brand_id", "brand_id").distinct(),
            p.select("type_id", "brand_id").distinct(),
            p.select("type_id", "type_id").distinct(),
        ]
        out = edges[0]
        for edge in edges[1:]:
            out = out.union(edge)
        return out.toDF("ancestor_concept_id", "descendant_concept_id")

    def person() -> DataFrame:
        nation = read("nation").select("n_nationkey", "n_regionkey")
        customer = read("customer").select("c_custkey", "c_nationkey")
        key = F.col("c_custkey")
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            key.alias("person_id"),
            (1915 + key * 37 % 75).cast("int").alias("year_of_birth"),
            F.when(key % 2 == 0, 8532).otherwise(8507).alias("gender_concept_id"),
            F.col("n_regionkey").alias("race_concept_id"),
            F.when(key % 5 == 0, 38003563).otherwise(38003564).alias("ethnicity_concept_id"),
        )

    def observed() -> DataFrame:
        return (
            base(list(TYPES.values()))
            .groupBy("person_id")
            .agg(
                F.min("start_date").alias("observation_period_start_date"),
                F.max("start_date").alias("observation_period_end_date"),
            )
        )

    def observation_period() -> DataFrame:
        return staged("observation_period", observed, [])

    def death() -> DataFrame:
        return (
            observation_period()
            .filter(F.col("person_id") % 23 == 0)
            .select(
                "person_id",
                F.col("observation_period_end_date").alias("death_date"),
                F.when(F.col("person_id") % 2 == 0, 10301).cast("long").alias("cause_concept_id"),
            )
        )

    def visit_occurrence() -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return read("orders").select(
            F.col("o_orderkey").alias("visit_occurrence_id"),
            F.col("o_custkey").alias("person_id"),
            F.when(first == "1", 9203).when(first == "2", 9201).otherwise(9202).alias(
                "visit_concept_id"
            ),
        )

    def procedure_occurrence() -> DataFrame:
        return base(DOMAIN_TYPES["procedure"]).select(
            F.col("occ_id").alias("procedure_occurrence_id"),
            "person_id",
            F.col("concept_id").alias("procedure_concept_id"),
            F.col("start_date").alias("procedure_date"),
            "visit_occurrence_id",
        )

    def condition_occurrence() -> DataFrame:
        return base(DOMAIN_TYPES["condition"]).select(
            F.col("occ_id").alias("condition_occurrence_id"),
            "person_id",
            F.col("concept_id").alias("condition_concept_id"),
            F.col("start_date").alias("condition_start_date"),
            F.col("end_date").alias("condition_end_date"),
            F.col("type_id").alias("condition_type_concept_id"),
            "visit_occurrence_id",
        )

    def drug_exposure() -> DataFrame:
        return base(DOMAIN_TYPES["drug"]).select(
            "person_id",
            F.col("concept_id").alias("drug_concept_id"),
            F.col("start_date").alias("drug_exposure_start_date"),
        )

    def device_exposure() -> DataFrame:
        return base([2]).filter(F.col("type_id") == 38000230).select(
            "person_id",
            (3000 + F.col("l_suppkey") % 20).alias("device_concept_id"),
            F.col("start_date").alias("device_exposure_start_date"),
        )

    def specimen() -> DataFrame:
        return base([3]).filter(F.col("l_suppkey") % 10 == 0).select(
            "person_id",
            (4000 + F.col("l_partkey") % 10).alias("specimen_concept_id"),
            F.col("start_date").alias("specimen_date"),
        )

    def observation() -> DataFrame:
        return read("orders").select(
            F.col("o_custkey").alias("person_id"),
            (2000 + F.substring("o_orderpriority", 1, 1).cast("long")).alias(
                "observation_concept_id"
            ),
            F.to_date("o_orderdate").alias("observation_date"),
        )

    def measurement() -> DataFrame:
        kind = F.lit(None).cast("long")
        for index, label in enumerate(["click", "error", "purchase", "signup", "view"], start=1):
            kind = F.when(F.col("event_type") == label, F.lit(index)).otherwise(kind)
        return read("events").select(
            F.col("user_id").alias("person_id"),
            kind.cast("long").alias("measurement_concept_id"),
            # The days of one month spread over the years of the study.
            F.date_sub(F.to_date("ts"), (F.lit(8766) + F.col("event_id") * 37 % 1461).cast("int"))
            .alias("measurement_date"),
            F.col("value").alias("value_as_number"),
            F.lit(1.0).alias("range_low"),
            F.lit(100.0).alias("range_high"),
        )

    builders = {
        "concept": lambda: staged("concept", concept, []),
        "concept_ancestor": lambda: staged("concept_ancestor", concept_ancestor, []),
        "person": person,
        "observation_period": observation_period,
        "death": death,
        "visit_occurrence": visit_occurrence,
        "procedure_occurrence": procedure_occurrence,
        "condition_occurrence": condition_occurrence,
        "drug_exposure": drug_exposure,
        "device_exposure": device_exposure,
        "specimen": specimen,
        "observation": observation,
        "measurement": measurement,
        "condition_era": lambda: staged("condition_era", lambda: eras("condition"), []),
        "drug_era": lambda: staged("drug_era", lambda: eras("drug"), []),
    }
    return Cdm(lambda table: builders[table]())


def _era_sql(domain: str) -> str:
    return f"""
        SELECT brand_id * 1000 + era AS {domain}_era_id, person_id, brand_id AS {domain}_concept_id,
               min(start_date) AS {domain}_era_start_date, max(end_date) AS {domain}_era_end_date
        FROM (SELECT *, sum(opens) OVER (PARTITION BY person_id, brand_id ORDER BY start_date) AS era
              FROM (SELECT *, CASE WHEN start_date <= max(end_date) OVER (
                                PARTITION BY person_id, brand_id ORDER BY start_date
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {ERA_GAP_DAYS}
                                   THEN 0 ELSE 1 END AS opens
                    FROM (SELECT person_id, brand_id, start_date,
                                 max(coalesce(end_date, start_date + 1)) AS end_date
                          FROM base WHERE t IN ({", ".join(map(str, DOMAIN_TYPES[domain]))})
                          GROUP BY ALL)))
        GROUP BY person_id, brand_id, era"""


TYPE_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPES.items()) + " END"

CDM_VIEWS = {
    "parts": f"""
        SELECT p_partkey, p_size, {TYPE_SQL} AS t,
               CAST(10000 + 100 * {TYPE_SQL} + CAST(substr(p_brand, 7) AS INTEGER) AS BIGINT)
                   AS brand_id
        FROM part""",
    "base": """
        SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS occ_id,
               o_custkey AS person_id, l_orderkey AS visit_occurrence_id,
               1000000 + l_partkey AS concept_id, l_partkey, l_suppkey, t, brand_id,
               min(CAST(l_shipdate AS DATE)) AS start_date,
               min(CASE WHEN l_returnflag <> 'N' THEN
                   CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) % 14 END) AS end_date,
               min(CASE WHEN l_linestatus = 'F' THEN 38000184 ELSE 38000230 END) AS type_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "concept": """
        SELECT 1000000 + p_partkey AS concept_id,
               CASE WHEN p_size = 50 THEN 'D' END AS invalid_reason, 'S' AS standard_concept
        FROM parts
        UNION ALL SELECT DISTINCT brand_id, CAST(NULL AS VARCHAR), 'S' FROM parts
        UNION ALL SELECT DISTINCT 100 + t, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM parts""",
    "concept_ancestor": """
        SELECT 1000000 + p_partkey AS ancestor_concept_id,
               1000000 + p_partkey AS descendant_concept_id FROM parts
        UNION ALL SELECT brand_id, 1000000 + p_partkey FROM parts
        UNION ALL SELECT 100 + t, 1000000 + p_partkey FROM parts
        UNION ALL SELECT DISTINCT brand_id, brand_id FROM parts
        UNION ALL SELECT DISTINCT 100 + t, brand_id FROM parts
        UNION ALL SELECT DISTINCT 100 + t, 100 + t FROM parts""",
    "person": """
        SELECT c_custkey AS person_id, CAST(1915 + c_custkey * 37 % 75 AS INTEGER) AS year_of_birth,
               CASE WHEN c_custkey % 2 = 0 THEN 8532 ELSE 8507 END AS gender_concept_id,
               n_regionkey AS race_concept_id,
               CASE WHEN c_custkey % 5 = 0 THEN 38003563 ELSE 38003564 END AS ethnicity_concept_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "observation_period": """
        SELECT person_id, min(start_date) AS op_start, max(start_date) AS op_end
        FROM base GROUP BY person_id""",
    "death": """
        SELECT person_id, op_end AS death_date,
               CASE WHEN person_id % 2 = 0 THEN 10301 END AS cause_concept_id
        FROM observation_period WHERE person_id % 23 = 0""",
    "visit_occurrence": """
        SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 9203 WHEN '2' THEN 9201
                    ELSE 9202 END AS visit_concept_id
        FROM orders""",
    "procedure_occurrence": """
        SELECT occ_id AS procedure_occurrence_id, person_id, concept_id AS procedure_concept_id,
               start_date AS procedure_date, visit_occurrence_id
        FROM base WHERE t = 2""",
    "condition_occurrence": """
        SELECT occ_id AS condition_occurrence_id, person_id, concept_id AS condition_concept_id,
               start_date AS condition_start_date, end_date AS condition_end_date,
               type_id AS condition_type_concept_id, visit_occurrence_id
        FROM base WHERE t IN (3, 5)""",
    "drug_exposure": """
        SELECT person_id, concept_id AS drug_concept_id, start_date AS drug_exposure_start_date
        FROM base WHERE t IN (1, 4, 6)""",
    "device_exposure": """
        SELECT person_id, 3000 + l_suppkey % 20 AS device_concept_id,
               start_date AS device_exposure_start_date
        FROM base WHERE t = 2 AND type_id = 38000230""",
    "specimen": """
        SELECT person_id, 4000 + l_partkey % 10 AS specimen_concept_id, start_date AS specimen_date
        FROM base WHERE t = 3 AND l_suppkey % 10 = 0""",
    "observation": """
        SELECT o_custkey AS person_id,
               2000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS observation_concept_id,
               CAST(o_orderdate AS DATE) AS observation_date
        FROM orders""",
    "measurement": """
        SELECT user_id AS person_id,
               CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                    WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS measurement_concept_id,
               CAST(ts AS DATE) - CAST(8766 + event_id * 37 % 1461 AS INTEGER) AS measurement_date,
               value AS value_as_number, 1.0 AS range_low, 100.0 AS range_high
        FROM events""",
    "condition_era": _era_sql("condition"),
    "drug_era": _era_sql("drug"),
}
