"""Near-duplicate documents: bottom-k sketches, inverted lists, exact check in blocks.

1. One hash function maps a text's distinct word shingles to a set; its ``k`` smallest values are
   its sketch. Texts with the same set form one class, so exact copies cost one row afterwards.
2. Inverted lists of the retained values. A value of a single class links nothing. A pair at the
   threshold shares at least ``share`` of its retained values, so only the rarest
   ``retained - needed + 1`` of them have to be looked up (prefix filter); a class whose own values
   use these up has no partner at all.
3. The lists join classes into candidate groups by stars, so a frequent value costs as many rows as
   it has classes, never their pairs.
4. Inside each group the full sets are compared exactly. A group is cut into blocks of bounded size
   and each pair of blocks is one task row group; its output is a spanning forest of its links. Within
   a block pair the sketches' union estimate drops hopeless pairs before the full sets are counted.
5. Components of these forests are the duplicate classes.

Sets up to ``k * threshold`` long are compared through whole sets, so nothing is estimated for
them. For longer ones the needed share lies more than five standard deviations below what a pair at
the threshold is expected to share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words
from twinarm.llm.graph import EDGE, components, forest
from twinarm.llm.storage import stage

WIDTH = 5
#: Retained values of a sketch.
K = 64
#: Similarity of linked documents, as a fraction of whole numbers.
SIMILARITY = (85, 100)
#: Standard deviations between the share of retained values that a pair at the threshold is expected
#: to have in common and the share that it needs.
MARGIN = 5.6
#: Shingles of one block; a task compares two blocks.
BLOCK_SHINGLES = 100_000
#: Bits of the candidate filter, at most 16 MB; more candidates only make it pass more rows.
FILTER_BITS = (1 << 16, 1 << 27)


def needed_share(similarity: tuple[int, int], k: int = K) -> float:
    """Share of the retained values that a pair must have in common, for sets that are not kept whole.
    A subset at the threshold shares least: each retained value of the larger set with that chance."""
    part, whole = similarity
    return max(0.0, part / whole - MARGIN * np.sqrt(part * (whole - part) / k) / whole)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, places in words.slices(column):
        found = words.split(data, places, "spaced")
        yield from words.shingles(words.hashes(found), found.first, WIDTH)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def set_key(values: np.ndarray) -> int:
    """64-bit key of a whole set, whatever the order of its values."""
    total = np.add.reduce(words.mix(values), dtype=np.uint64) + np.uint64(len(values))
    return int(words.mix(np.array([total]))[0].view(np.int64))


def _sketcher(k: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, keys = [], [], []
            for values in _sets(batch.column(1)):
                kept.append(values[:k].copy())
                sizes.append(len(values))
                keys.append(set_key(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), _lists(kept)],
                names=["id", "n", "set_key", "sketch"],
            )

    return sketch


def _bits(candidates: DataFrame, key: str) -> np.ndarray:
    """Bit table of the candidates' keys: bounded by FILTER_BITS, collected as set positions."""
    n = candidates.count()
    size = FILTER_BITS[0]
    while size < min(16 * n, FILTER_BITS[1]):
        size *= 2
    bits = np.zeros(size // 8, np.uint8)
    # Bitmap positions count from 1.
    spread = (candidates.select((F.pmod(F.xxhash64(key), F.lit(size)) + 1).alias("p"))
              .select(F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("place"))
              .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map")))
    for row in spread.collect():  # 4 KB a row, as many as the table has room for
        part = np.frombuffer(bytes(row["map"]), np.uint8)
        at = (row["bucket"] - 1) * len(part)
        bits[at : at + len(part)] |= part[: len(bits) - at]
    return bits


def _resetter(rows_filter, size: int):
    """Full sets of the rows whose key may be a candidate's."""

    def full(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = rows_filter.value
        for batch in batches:
            place = batch.column(1).to_numpy()
            pick = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(pick.astype(bool)))
            if not batch.num_rows:
                continue
            parts = list(_sets(batch.column(2)))
            keys = pa.array([set_key(v) for v in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, _lists(parts)], names=["id", "set_key", "values"])

    return full


def _overlaps(sets: list[np.ndarray], m: int, n: int) -> np.ndarray:
    """Sizes of the intersections of the first ``m`` sets with those from ``n`` on."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((m, len(sets) - n), np.float32)
    width = 2048
    cut = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for step, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        hits = np.zeros((len(sets), width), np.float32)
        hits[owner[a:b], column[a:b] - step * width] = 1
        both += hits[:m] @ hits[n:].T
    return both.astype(np.int64)


def union_estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (one a row, padded with the largest value) by the share of
    common values among the smallest of their union."""
    k = left.shape[1]
    top = np.iinfo(left.dtype).max
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    rank = np.cumsum(~twice & (both != top), axis=1)
    common = (twice & (rank <= k)).sum(axis=1)
    return common / np.maximum(1, np.minimum(rank[:, -1], k))


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: tuple[int, int],
                 k: int = K, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets (sorted arrays): between ``left`` and ``right``, or among ``left`` if
    that is None. Overlaps of the sketches come first, then the union estimate, then the full sets."""
    part, whole = similarity
    share = needed_share(similarity, k) if share is None else share
    sets = left if right is None else [*left, *right]
    m, n = len(left), 0 if right is None else len(left)
    sizes = np.array([len(s) for s in sets], np.int64)
    kept = np.minimum(sizes, k)
    whole_sets = sizes * whole <= k * part
    needed = np.where(whole_sets, -(-sizes * part // whole), np.maximum(1, (kept * share).astype(np.int64)))
    over = _overlaps([s[:k] for s in sets], m, n)
    a, b = np.nonzero(over >= np.maximum(needed[:m, None], needed[None, n:]) * (over > 0))
    pick = over[a, b] > 0
    a, b = a[pick], b[pick] + n
    if right is None:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return a, b
    table = np.full((len(sets), k), np.iinfo(sets[0].dtype).max, sets[0].dtype)
    for i, s in enumerate(sets):
        table[i, : kept[i]] = s[:k]
    floor = part / whole - 5 * np.sqrt(part * (whole - part)) / whole / np.sqrt(k)
    near = np.concatenate([union_estimate(table[a[i : i + 20_000]], table[b[i : i + 20_000]]) >= floor
                           for i in range(0, len(a), 20_000)])
    a, b = a[near], b[near]
    if not len(a):
        return a, b
    rows, cols = np.unique(a), np.unique(b)
    inter = _overlaps([sets[i] for i in rows] + [sets[i] for i in cols], len(rows), len(rows))
    inter = inter[np.searchsorted(rows, a), np.searchsorted(cols, b)]
    linked = whole * inter >= part * (sizes[a] + sizes[b] - inter)
    return a[linked], b[linked] - n


def _comparer(similarity: tuple[int, int], k: int, share: float):
    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        keys = table.column("set_key").to_numpy()
        values = table.column("values").combine_chunks()
        ends = values.offsets.to_numpy()
        flat = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = table.column("i")[0] == table.column("j")[0]
        if not len(first) or not within and not len(second):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = linked_pairs([sets[i] for i in first], None if within else [sets[i] for i in second], similarity, k, share)
        node, root = forest(keys[first[a]], keys[(first if within else second)[b]])
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    return compare


def candidate_groups(classes: DataFrame, k: int, similarity: tuple[int, int], share: float) -> DataFrame:
    """``set_key, grp`` of classes that may have a linked partner; linked classes share a group."""
    part, whole = similarity
    kept = F.least(F.col("n"), F.lit(k))
    needed = F.when(F.col("n") * whole <= k * part, F.ceil(F.col("n") * part / F.lit(whole))).otherwise(
        F.greatest(F.lit(1), F.floor(kept * share)))
    lists = classes.where("n > 0").select("set_key", "n", F.explode("sketch").alias("v"))
    common = stage(lists.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    own = (lists.join(common, "v")
           .groupBy("set_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("found"))
           .withColumn("look", F.size("found") - needed + 1).where("look > 0"))
    prefix = stage(own.select("set_key", F.explode(F.slice("found", F.lit(1), F.col("look").cast("int"))).alias("f"))
                   .select("set_key", F.col("f.v").alias("v")))
    low = stage(prefix.groupBy("v").agg(F.min("set_key").alias("first"), F.count("*").alias("c")).where("c > 1"))
    star = prefix.join(low, "v").where("set_key <> first").select(F.col("set_key").alias("a"), F.col("first").alias("b"))
    found = components(star)
    return found.select(F.col("node").alias("set_key"), F.col("root").alias("grp")).unionByName(
        found.select(F.col("root").alias("set_key"), F.col("root").alias("grp")).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 similarity: tuple[int, int] = SIMILARITY, share: float | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n`` (size of its shingle set), ``component`` (smallest id
    reachable over links) and ``kept`` (whether that is its own id).

    Null or empty texts have no set and link with nothing, not even each other. Equal rows are kept
    as rows and share a class. A null id never names a class; a class of null ids alone has a null
    component and is kept. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    share = needed_share(similarity, k) if share is None else share
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = stage(picked.mapInArrow(_sketcher(k), "id long, n long, set_key long, sketch array<long>"))
    classes = stage(sketches.where("n > 0").groupBy("set_key", "n").agg(
        F.min("id").alias("low"), F.first("sketch").alias("sketch")))
    groups = stage(candidate_groups(classes, k, similarity, share))
    members = stage(groups.join(classes.select("set_key", "n", "low"), "set_key"))

    # Full sets, one row a class, only for rows that may be the first of a candidate class.
    bits = _bits(members, "low")
    shared = spark.sparkContext.broadcast(bits)
    full = (picked.select("id", F.pmod(F.xxhash64("id"), F.lit(len(bits) * 8)).alias("place"), "text")
            .mapInArrow(_resetter(shared, len(bits)), "id long, set_key long, values array<long>")
            .dropDuplicates(["set_key", "id"]))
    # Weight of a group decides the number of its blocks; a class goes to one of them by its key.
    blocks = stage(members.groupBy("grp").agg(
        F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("c")).where("c > 1"))
    placed = stage(members.join(blocks, "grp").select(
        "set_key", "low", "grp", "blocks", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block")))
    sets = (full.join(placed, (full["set_key"] == placed["set_key"]) & full["id"].eqNullSafe(placed["low"]))
            .select(placed["set_key"], "grp", "blocks", "block", "values"))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "set_key", "values")
    links = stage(dealt.groupBy("grp", "i", "j")
                  .applyInArrow(_comparer(similarity, k, share), EDGE))
    roots = components(links)
    named = stage(classes.select("set_key", "low").join(
        roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
        .withColumn("root", F.coalesce("root", "set_key")))
    lowest = stage(named.groupBy("root").agg(F.min("low").alias("component")))
    final = stage(named.join(lowest, "root").select("set_key", "component"))
    # A row without a set meets no class: its component is its own id.
    keyed = sketches.select("id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
    out = keyed.join(final, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", "n", component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                similarity: tuple[int, int] = SIMILARITY, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, all columns kept.

    Rows are named by their ids: an id stays if any of its rows is kept, and rows without an id stay.
    A bit table of the ids to drop lets most rows pass without a shuffle; the rest meet the ids.
    """
    spark = docs.sparkSession
    gone = stage(near_classes(docs, id_col, text_col, k, similarity, share).where("id is not null")
                 .groupBy("id").agg(F.max("kept").alias("kept")).where("not kept").select("id"))
    bits = spark.sparkContext.broadcast(_bits(gone, "id"))
    size = len(bits.value) * 8
    mark = "twinarm_place"
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(size)).alias(mark), F.struct("*").alias("twinarm_row"))

    def passing(wanted: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = bits.value
            for batch in batches:
                place = batch.column(0).to_numpy()
                hit = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                yield batch.filter(pa.array(hit == wanted))

        return run

    free = rows.mapInArrow(passing(0), rows.schema).select("twinarm_row.*")
    held = rows.mapInArrow(passing(1), rows.schema).select("twinarm_row.*")
    held = held.join(gone.withColumnRenamed("id", "twinarm_id"), F.col(id_col).cast("long") == F.col("twinarm_id"), "left_anti")
    return free.unionByName(held)
