"""Hard negatives for anchors by Fagin's threshold algorithm over sorted lists.

Rows of one label (of rare labels together) are dealt into blocks. In a task a block has one list of its
rows for each dimension, sorted by that component; anchors visit blocks in groups of bounded size. For an
anchor the lists are read together from the end that its sign favours. Every row met is scored in full, as a whole
number, and the components at the places reached bound the score of every row not met yet (the
threshold). A visit ends once the threshold is strictly below what is still wanted: rows with equal
scores are told apart by id, so an equal threshold is not enough.

First anchors visit the blocks of their own label for their positives. These set a window of scores
each, and anchors then visit the blocks of all other labels for the best rows of all their windows at
once. The best of each block are merged by a ranking that is cut before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinarm.llm.storage import stage

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Positives of an anchor, negatives of a window.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of its positive's score.
WINDOW = (50, 95)
#: Rows of a block, and anchors that visit it in one task.
BLOCK, VISITORS = 16_384, 8_192
#: Places of each list that are read first; then twice as many, and so on.
DEPTH = 32
#: Rows of a table that is sent to every executor; a larger one is joined by a shuffle.
SMALL = 100_000
#: Squared length of a quantised row, below which all scores fit 64 bits.
TOP = float(1 << 62)


def quantised(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Rounded components of each row; None if the row can't be scored."""
    for values in column.to_pylist():
        if values is None or not values or any(v is None for v in values):
            yield None
            continue
        x = np.floor(SCALE * np.array(values, np.float64))
        yield x if np.isfinite(x).all() and x @ x < TOP else None


class Lists(NamedTuple):
    """Rows of a block in the order of their ids, and for each dimension their places sorted by it."""

    ids: np.ndarray
    rows: np.ndarray
    order: np.ndarray  # dimension by place
    sorted: np.ndarray  # the components in that order


def lists(ids: np.ndarray, rows: np.ndarray) -> Lists:
    by = np.argsort(ids, kind="stable")
    ids, rows = ids[by], np.ascontiguousarray(rows[by])
    order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
    return Lists(ids, rows, order.astype(np.int32), np.take_along_axis(rows.T, order, axis=1))


def _hundredfold(scores: np.ndarray) -> np.ndarray:
    large = len(scores) and int(np.abs(scores).max()) >= 1 << 56
    return (scores.astype(object) if large else scores) * 100


def best(found: Lists, anchor: np.ndarray, own: int, allowed: np.ndarray | None, windows: list[tuple[float, float]], k: int,
         depth: int = DEPTH) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window of scores (hundredfold; ends included) the ids and scores of its ``k`` best rows,
    higher scores and then smaller ids first, and the number of rows scored. The row of id ``own`` and
    rows that are not ``allowed`` (a mask, or None for all) are left out."""
    n = len(found.ids)
    down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool) if allowed is None else ~allowed
    seen |= found.ids == own
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    scored, start = 0, 0
    while start < n:
        # An anchor of zeros reads no list: it scores every row alike.
        end = min(n, start + depth) if len(down) or len(up) else n
        reached = np.full(n, not len(down) and not len(up))
        reached[found.order[down, n - end : n - start]] = True
        reached[found.order[up, start:end]] = True
        new = np.flatnonzero(reached & ~seen)
        seen |= reached
        scored += len(new)
        scores, ids = found.rows[new] @ anchor, found.ids[new]
        threshold = int(found.sorted[down, n - end] @ anchor[down]) + int(found.sorted[up, end - 1] @ anchor[up])
        hundred = _hundredfold(scores)
        wanted = False
        for w, (low, high) in enumerate(windows):
            inside = (hundred >= low) & (hundred <= high)
            i, s = np.concatenate([held[w][0], ids[inside]]), np.concatenate([held[w][1], scores[inside]])
            pick = np.lexsort((i, -s))[:k]
            held[w] = i[pick], s[pick]
            full = len(pick) == k and threshold < int(s[pick[-1]])
            wanted |= not full and 100 * threshold >= low
        if not wanted:
            break
        start, depth = end, 2 * depth
    return held, scored


_EVERY = (-float("inf"), float("inf"))
_WINDOWS = "array<struct<positive:long,positive_score:long>>"
FOUND = "anchor long, mark long, label long, rival long, score long, positive long, positive_score long"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


def _visit(k: int, own_label: bool):
    """Best rows of one block for each anchor of one group; rows of ``side`` 0 are the block."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, marks, labels = (table[c].to_numpy() for c in ("side", "id", "mark", "label"))
        vectors = table["x"].combine_chunks()
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        block, anchors = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple] = []
        if len(block) and len(anchors):
            found, windows = lists(ids[block], matrix[block]), table["windows"].to_pylist()
            of = labels[block][np.argsort(ids[block], kind="stable")]
            one = (of == of[0]).all()
            for a in anchors.tolist():
                # A negative score has no window: its upper end lies below its lower one.
                given = [(None, None)] if own_label else [
                    (w["positive"], w["positive_score"]) for w in windows[a] if w["positive_score"] >= 0]
                bounds = [_EVERY if own_label else (WINDOW[0] * s, WINDOW[1] * s) for _, s in given]
                if not given or one and (of[0] == labels[a]) != own_label:
                    continue
                allowed = None if one else (of == labels[a]) == own_label
                rivals = best(found, matrix[a], int(ids[a]), allowed, bounds, k)[0]
                for (positive, score), (i, s) in zip(given, rivals, strict=True):
                    out += [(int(ids[a]), int(marks[a]), int(labels[a]), x, y, positive, score)
                            for x, y in zip(i.tolist(), s.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * len(_FOUND)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def _prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(quantised(batch.column(2)))
        keep = [i for i, x in enumerate(rows) if x is not None]
        x = [rows[i].astype(np.int64) for i in keep]
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(x, pa.list_(pa.int64())),
             pa.array([len(v) for v in x], pa.int32())], names=["id", "label", "x", "size"])


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           relabel: int = 7, labels: int = 10) -> DataFrame:
    """``id, label, x, size, mark`` of the rows that take part: ``x`` are the rounded components, ``label``
    is moved on by one where ``relabel`` divides the id, ``mark`` tells rows of one id apart. Equal rows
    are one row."""
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col).cast("long") % relabel == 0, (label + 1) % labels).otherwise(label)
    named = rows.select(F.col(id_col).cast("long").alias("id"), moved.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return (named.where("id is not null and label is not null and v is not null")
            .mapInArrow(_prepare, "id long, label long, x array<long>, size int")
            .withColumn("mark", F.xxhash64("x", "label")).dropDuplicates(["id", "mark", "label", "size"]))


def _blocks(known: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``known`` with the ``family`` and ``block`` of each row, and the families with their sizes.

    A label with many rows is a family of its own. Rarer labels share families, so that there are never
    more blocks than a few for ``block`` rows.
    """
    counts = stage(known.groupBy("size", "label").agg(F.count("*").alias("c")))
    rare = F.col("c") * 4 < block
    shared = counts.where(rare).groupBy("size").agg(F.ceil(F.sum("c") / F.lit(block)).alias("homes"))
    family = F.when(rare, F.pmod(F.xxhash64("label"), F.col("homes")).cast("string")).otherwise(
        F.concat(F.lit("label "), F.col("label").cast("string")))
    homes = stage(counts.join(shared, "size", "left").withColumn("family", family).drop("homes"))
    families = stage(homes.groupBy("size", "family").agg(F.ceil(F.sum("c") / F.lit(block)).cast("int").alias("blocks")))
    placed = known.join(_small(homes.join(families, ["size", "family"]).select("size", "label", "family", "blocks")), ["size", "label"])
    return stage(placed.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int")).drop("blocks")), families


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _best_of_blocks(placed: DataFrame, families: DataFrame, anchors: DataFrame, k: int, own_label: bool, visitors: int) -> DataFrame:
    """Best rows of every block that an anchor has to visit: those of its own family, or all but those of
    its own label. A block goes once to every group of anchors."""
    groups = max(1, -(-anchors.count() // visitors))
    dealt = anchors.withColumn("grp", F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).cast("int"))
    to = families.withColumnRenamed("family", "to").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if own_label:
        visits = dealt.join(_small(to.withColumnRenamed("to", "family")), ["size", "family"]).withColumn("to", F.col("family"))
    else:
        visits = dealt.join(_small(to), "size").where(F.col("to") != F.concat(F.lit("label "), F.col("label").cast("string")))
    columns = ["grp", "size", "to", "block", "side", "id", "mark", "label", "x", "windows"]
    visits = visits.withColumn("side", F.lit(1)).select(columns)
    hosts = (placed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("to", F.col("family"))
             .withColumn("side", F.lit(0)).withColumn("windows", F.lit(None).cast(_WINDOWS)).select(columns))
    return hosts.unionByName(visits).groupBy("grp", "size", "to", "block").applyInArrow(_visit(k, own_label), FOUND)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   every: int = 50, relabel: int = 7, labels: int = 10, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``every`` divides. A score is the inner product of the components,
    each ``floor(256 * x)``. An anchor's positives are its ``POSITIVES`` best other rows of its label; for
    each of them come the ``NEGATIVES`` best rows of other labels whose score lies in ``WINDOW`` hundredths
    of the positive's, ties by smaller id. Anchors without positives or negatives have no rows.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or components
    so large that scores leave 64 bits (some eight million) take no part. Rows are compared with rows of
    as many components only. Equal rows are one row; rows that share an id are never each other's
    positives or negatives. Nothing is read but the three columns.
    """
    known = stage(usable(rows, id_col, vector_col, label_col, relabel, labels))
    placed, families = _blocks(known, block)
    anchors = placed.where(F.col("id") % every == 0).drop("block")
    of = ["anchor", "mark", "label"]
    order = [F.col("score").desc(), F.col("rival")]
    first = _best_of_blocks(placed, families, anchors.withColumn("windows", F.lit(None).cast(_WINDOWS)), POSITIVES, True, visitors)
    top = first.withColumn("at", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("at") <= POSITIVES)
    windows = F.collect_list(F.struct(F.col("rival").alias("positive"), F.col("score").alias("positive_score")))
    given = top.groupBy(*of).agg(windows.alias("windows")).withColumnRenamed("anchor", "id")
    judged = stage(anchors.join(given, ["id", "mark", "label"]))
    second = stage(_best_of_blocks(placed, families, judged, NEGATIVES, False, visitors))
    ranked = Window.partitionBy(*of, "positive").orderBy(*order)
    return (second.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= NEGATIVES).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("rival").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")))
