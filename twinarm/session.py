"""Session settings, reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle: a person or concept
    # may hold a large share of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What one task of a shuffle takes; rows in memory need some twenty times their shuffled bytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A union that counts as partitioned like its parts fails ("Can't zip RDDs with unequal numbers of
    # partitions") once the parts are large enough to be joined by shuffles that adaptive execution changes.
    "spark.sql.unionOutputPartitioning": "false",
}
#: Stored bytes of input for each partition that a shuffle is first dealt into.
PARTITION_BYTES = 8_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators count on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def partitions_for(spark: SparkSession, paths: list[str]) -> int:
    """Partitions to deal shuffles into, by the stored size of the input; not fewer than the session asks for.

    With a fixed number the memory of a task, and what it spills, grows with the input. Adaptive execution
    puts small partitions together again, so a small input keeps few tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    size = files.agg(F.sum("length")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="twinarm-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives executor loss."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but written as columns and read back, for tables that a loop takes from round to round.

    A checkpoint keeps the size that Spark guessed for its plan, and a join multiplies the guesses of its sides: where
    a round joins what it made of the last one, the digits of the guess double and planning takes minutes after a
    dozen rounds. What is read back has the size of its files.
    """
    spark = df.sparkSession
    folder = f"{scratch_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint for ``df`` only after its row count has been checked.

    A larger table is returned as it is, so that Spark joins it with a shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
