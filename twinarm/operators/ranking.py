"""Row numbering that stays distributed when one group holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ids of one window of a hot group.
RANGE = 65_536


def sliced_row_number(
    df: DataFrame, keys: list[str], chunk: list[Column], order: list[Column], name: str
) -> DataFrame:
    """1-based position of each row within ``keys``, ordered by ``chunk`` and then ``order``.

    ``chunk`` must take few values per group (a date, an id range): only rows of one chunk meet in
    one window; the offsets of the chunks come from their counts.
    """
    chunk_names = [f"__chunk_{i}" for i in range(len(chunk))]
    tagged = reduce(lambda d, nc: d.withColumn(nc[0], nc[1]), zip(chunk_names, chunk), df)
    offsets = (
        tagged.groupBy(*keys, *chunk_names)
        .count()
        .withColumn(
            "__offset",
            F.sum("count").over(Window.partitionBy(*keys).orderBy(*chunk_names)) - F.col("count"),
        )
        .drop("count")
    )
    within = Window.partitionBy(*keys, *chunk_names).orderBy(*order)
    return (
        tagged.withColumn("__within", F.row_number().over(within))
        .join(offsets, [*keys, *chunk_names])
        .withColumn(name, F.col("__offset") + F.col("__within"))
        .drop("__offset", "__within", *chunk_names)
    )


def id_range(column: str) -> Column:
    """Range that an integer id falls into: rises with the id, so it can stand before the id in an
    order without changing it, and holds a bounded number of distinct ids."""
    return F.floor(F.col(column) / RANGE)
