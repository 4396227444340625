"""Tables written to the shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinarm.session import scratch_folder


#: Bytes of an Arrow batch on its way to Python; rows alone don't bound it where texts are long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches at ``BATCH_BYTES`` or below; a smaller setting of the session's stays."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back as columns."""
    spark = bound_batches(df.sparkSession)
    folder = f"{scratch_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
