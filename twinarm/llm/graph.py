"""Connected components of a large edge table by alternating stars, without collecting anything."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.storage import stage

EDGE = "a long, b long"
#: Edges that a task holds at once while it thins them out.
EDGES_AT_ONCE = 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, with that smallest node."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        a, b = forest(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(x.shape[1] for x in held) >= EDGES_AT_ONCE:
            yield flush()
            held = []
    if held:
        yield flush()


def components(edges: DataFrame, finish: int = EDGES_AT_ONCE) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns) but the smallest of each component,
    which is the root. Null ends and loops are ignored; no edges give no rows.

    Each partition first reduces its edges to a forest. Then large and small stars alternate until
    nothing changes; minima are partial aggregates and a hub's rows may be split in the joins, since
    the minima are written tables. As soon as no more than ``finish`` edges are left, which is what
    one task holds at once anyway, one task ends the work.
    """
    left, right = (F.col(c) for c in edges.columns)
    now = stage(edges.select(left.cast("long").alias("a"), right.cast("long").alias("b"))
                .where("a <> b").mapInArrow(_thin, EDGE))
    seen = None
    while True:
        if now.count() <= min(finish, EDGES_AT_ONCE - 1):
            now = stage(now.coalesce(1).mapInArrow(_thin, EDGE))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stage(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        now = stage(small.distinct().mapInArrow(_thin, EDGE).distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # Stars are final when every node has one root and no root is itself a node.
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
