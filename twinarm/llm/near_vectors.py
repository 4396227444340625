"""Near vectors by cosine with an inverted multi-index.

Unit vectors are cut into two halves with a codebook each; the pairs of codewords are the cells of a
grid. A vector is stored in its own cell and visits the cells nearest to it, in the order in which
the sum of both distances grows (the multi-sequence order). How many cells that are is measured: on
a sample, vectors are turned to exactly the threshold in random directions, and enough cells are
visited for the wished share of them to be met from one side or the other. All pairs met are then
checked in double precision.

Which cells a vector visits follows from one number, the sum at which it stops. So whether a pair is
met from both sides is known where it is found, links are counted without writing down pairs, and a
task gives back counts and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.graph import components, forest
from twinarm.llm.storage import stage

THRESHOLD, RECALL = 0.9, 0.995
#: Vectors that the codebooks are fitted on, and vectors turned to measure the visits.
SAMPLE, TURNED = 20_000, 2_000
#: Stored vectors that a task holds, and vectors by which visitors are dealt out further.
BLOCK, VISITORS = 4_096, 200_000
CODEWORDS = (4, 512)


class Index(NamedTuple):
    """``size``: components of the vectors it is for. ``visits``: cells of a traversal."""

    size: int
    first: np.ndarray
    second: np.ndarray
    visits: int


def _distances(z: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (z * z).sum(1)[:, None] - 2 * z @ words.T + (words * words).sum(1))


def _codebook(z: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = z[rng.choice(len(z), min(k, len(z)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(z, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, z)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def halves(index: Index, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = index.size // 2
    return _distances(unit[:, :cut], index.first), _distances(unit[:, cut:], index.second)


def stops(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """Sum of distances of the last cell visited: the ``visits``-th in multi-sequence order. Only the
    i-th and j-th nearest codewords with i * j <= visits can be among them."""
    visits = min(visits, d1.shape[1] * d2.shape[1])
    i, j = np.meshgrid(np.arange(d1.shape[1]), np.arange(d2.shape[1]), indexing="ij")
    ok = (i + 1) * (j + 1) <= visits
    out = np.empty(len(d1))
    s1, s2 = np.sort(d1, 1), np.sort(d2, 1)
    for a in range(0, len(d1), 2_000):
        sums = s1[a : a + 2_000, i[ok]] + s2[a : a + 2_000, j[ok]]
        out[a : a + 2_000] = np.partition(sums, visits - 1, axis=1)[:, visits - 1]
    return out


def fit(unit: np.ndarray, total: int, threshold: float, recall: float, seed: int = 0) -> Index:
    """Codebooks for about ``total`` vectors like the unit vectors given, and the visits they need."""
    rng = np.random.default_rng(seed)
    size = unit.shape[1]
    k = int(np.clip(2 * round(total**0.25), *CODEWORDS))
    index = Index(size, _codebook(unit[:, : size // 2], k, rng), _codebook(unit[:, size // 2 :], k, rng), 0)
    x = unit[rng.choice(len(unit), min(TURNED, len(unit)), replace=False)]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-300)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * side

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the cell of ``b`` in the traversal of ``a``."""
        (a1, a2), (b1, b2) = halves(index, a), halves(index, b)
        reach = a1[np.arange(len(a)), b1.argmin(1)] + a2[np.arange(len(a)), b2.argmin(1)]
        return np.array([(a1[i][:, None] + a2[i][None] <= reach[i]).sum() for i in range(len(a))])

    need = np.minimum(rank(x, y), rank(y, x))
    return index._replace(visits=int(np.quantile(need, recall, method="higher")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of a list column whose lists have ``size`` numbers each."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = "cid long, n long, size int, home int, second int, stop double, vec array<double>, visits array<int>"


def _placer(index: Index):
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            home, second = np.full(len(size), -1, np.int32), np.full(len(size), -1, np.int32)
            stop, visits = np.zeros(len(size)), [[-1]] * len(size)
            pick = np.flatnonzero(size == index.size)
            if len(pick):
                d1, d2 = halves(index, _matrix(batch.column(3).take(pa.array(pick)), index.size))
                home[pick], second[pick] = d1.argmin(1), d2.argmin(1)
                stop[pick] = stops(d1, d2, index.visits)
                reach = d1 + d2.min(1)[:, None] <= stop[pick][:, None]
                for i, row in zip(pick.tolist(), reach, strict=True):
                    visits[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(home), pa.array(second), pa.array(stop),
                 batch.column(3), pa.array(visits, pa.list_(pa.int32()))],
                names=["cid", "n", "size", "home", "second", "stop", "vec", "visits"])

    return place


FOUND = "a long, b long, n long"


def _checker(index: Index, threshold: float):
    """Rows of a sorted partition: the stored vectors of a block (kind 0), then its visitors (kind 1)."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                part = batch.slice(a, b - a)
                now = tuple(keys[a][:4])
                if now != key:
                    key, held, block = now, [], None
                if keys[a][4] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    block = _Block(pa.Table.from_batches(held), index)
                yield from block.links(part, index, threshold)

    return check


class _Block:
    def __init__(self, table: pa.Table, index: Index):
        self.size = int(table.column("size")[0].as_py())
        self.cid, self.n = table.column("cid").to_numpy(), table.column("n").to_numpy()
        self.home, self.second = table.column("home").to_numpy(), table.column("second").to_numpy()
        self.stop = table.column("stop").to_numpy()
        self.unit = _matrix(table.column("vec").combine_chunks(), self.size)

    def links(self, part: pa.RecordBatch, index: Index, threshold: float) -> Iterator[pa.RecordBatch]:
        names = part.schema.names
        col = {name: part.column(names.index(name)) for name in ("cid", "n", "home", "second", "stop", "vec")}
        cid, n = col["cid"].to_numpy(), col["n"].to_numpy()
        unit = _matrix(col["vec"], self.size)
        for at in range(0, len(cid), 1_000):
            near = unit[at : at + 1_000] @ self.unit.T >= threshold
            q, y = np.nonzero(near)
            q += at
            pick = cid[q] != self.cid[y]
            q, y = q[pick], y[pick]
            back = np.ones(len(q), bool)
            if self.size == index.size and len(q):
                home, second, stop = (col[c].to_numpy() for c in ("home", "second", "stop"))
                d1, d2 = halves(index, unit[q])
                there = np.arange(len(q))
                met = d1[there, self.home[y]] + d2[there, self.second[y]] <= stop[q]
                q, y = q[met], y[met]
                d1, d2 = halves(index, self.unit[y])
                there = np.arange(len(q))
                back = d1[there, home[q]] + d2[there, second[q]] <= self.stop[y]
            if not len(q):
                continue
            # The other side counts the pair itself where it comes this way too.
            node = np.concatenate([cid[q], self.cid[y[~back]]])
            count = np.concatenate([self.n[y], n[q[~back]]])
            who, of = np.unique(node, return_inverse=True)
            tree = forest(cid[q], self.cid[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([who, tree[0]])),
                 pa.array(np.concatenate([who, tree[1]])),
                 pa.array(np.concatenate([np.bincount(of, count).astype(np.int64), np.zeros(len(tree[0]), np.int64)]))],
                names=["a", "b", "n"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``id, n_links, component, kept`` of each row of ``vectors``.

    Links join rows whose cosine is at least ``threshold``; copies of a vector link with each other,
    rows that share an id included. Vectors that are null, empty or zero, or hold a null or a
    non-finite number, link with nothing and are their own component; so do vectors of different
    lengths. Vectors of other than the commonest length are compared in full within their length. A
    null id never names a component.
    """
    spark = vectors.sparkSession
    x = F.col("vec")
    good = (F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = stage(rows.withColumn("good", F.coalesce(good, F.lit(False)))
                 .withColumn("k1", F.when(F.col("good"), F.xxhash64("vec")))
                 .withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(1), "vec"))))
    classes = stage(rows.where("good").groupBy("k1", "k2").agg(
        F.min("id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("size", F.size("vec")))
    sizes = {r["size"]: r["c"] for r in classes.groupBy("size").agg(F.count("*").alias("c")).collect()}
    common = max(sorted(sizes), key=sizes.get, default=0)
    total = sizes.get(common, 0)
    named = classes
    out_counts = None
    if common:
        share = int(min(1.0, sample / total) * (1 << 30))
        picked = classes.where((F.col("size") == common) & (F.pmod("k2", F.lit(1 << 30)) < share)).select("k1", "vec").toArrow().sort_by("k1")
        unit = _matrix(picked.column("vec").combine_chunks(), common) if picked.num_rows else np.eye(1, common)
        index = fit(unit, total, threshold, recall)
        placed = stage(classes.select(F.col("k1").alias("cid"), "n", "size", "vec").mapInArrow(_placer(index), PLACED))
        blocks = placed.groupBy("size", "home").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        blocks = stage(blocks.withColumnsRenamed({"size": "bs", "home": "bh"}))
        slices = max(1, -(-sum(sizes.values()) // VISITORS))
        spread = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        stored = (placed.join(blocks, (F.col("size") == F.col("bs")) & (F.col("home") == F.col("bh")))
                  .select("size", "home", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), spread.alias("slice"),
                          F.lit(0).alias("kind"), "cid", "n", F.col("home").alias("h"), "second", "stop", "vec"))
        visiting = (placed.withColumn("cell", F.explode("visits"))
                    .join(blocks, (F.col("size") == F.col("bs")) & (F.col("cell") == F.col("bh")))
                    .select("size", F.col("cell").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                            F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(slices)).cast("int").alias("slice"),
                            F.lit(1).alias("kind"), "cid", "n", F.col("home").alias("h"), "second", "stop", "vec"))
        both = stored.unionByName(visiting).repartition("size", "home", "block", "slice").sortWithinPartitions(
            "size", "home", "block", "slice", "kind")
        found = stage(both.select("size", F.col("home").alias("cell"), "block", "slice", "kind", "cid", "n", F.col("h").alias("home"),
                                  "second", "stop", "vec").mapInArrow(_checker(index, threshold), FOUND))
        out_counts = found.where("a = b").groupBy(F.col("a").alias("k1")).agg(F.sum("n").alias("linked"))
        roots = components(found.where("a <> b").select("a", "b"))
        named = (classes.select("k1", "low", "n").join(out_counts, "k1", "left")
                 .join(roots.select(F.col("node").alias("k1"), "root"), "k1", "left")
                 .select("k1", "low", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "k1").alias("root")))
    else:
        named = classes.select("k1", "low", F.lit(0).cast("long").alias("n_links"), F.col("k1").alias("root"))
    named = stage(named)
    lowest = stage(named.groupBy("root").agg(F.min("low").alias("component")))
    final = stage(named.join(lowest, "root").select("k1", "n_links", "component"))
    out = rows.select("id", "k1").join(final, "k1", "left")
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
                      component.eqNullSafe(F.col("id")).alias("kept"))
