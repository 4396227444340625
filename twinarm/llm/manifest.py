"""Merkle manifest of a table: a hash tree for each group, a tree over the groups' roots, and a proof for
every row by pointer jumping.

1. A row's leaf hashes its fields. Rows get their places within their group from a range sort and the
   row counts of its partitions, so a group may hold any share of all rows.
2. The tree rises ``BLOCK_LEVELS`` levels a shuffle: the nodes of one block meet in one task, which
   returns every node with its sibling.
3. Pointer jumping: a node holds the siblings from itself up to an ancestor, at first its parent. Each
   round joins nodes with their ancestors and concatenates both segments, which doubles the distance.
   After round ``k`` only nodes on levels divisible by ``2^k`` can be met again, so the others go; the
   leaves stay until their segments reach the root.
4. Groups' roots are leaves of one more tree, proved by the same two steps.

Siblings travel as 32-byte digests and are hashed as their hex text. A last node without a sibling is
hashed alone, and its segment has nothing for that level.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinarm.llm.storage import stage

#: Levels that one shuffle adds to a tree; a task holds 2^BLOCK_LEVELS nodes of a block.
BLOCK_LEVELS = 12
#: Bytes of ancestors' segments that are sent to every executor; more are joined by a shuffle.
SMALL_BYTES = 2_000_000
#: Groups whose roots are sent to every executor; more are joined by a shuffle.
SMALL_GROUPS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """Hex sha256 of the values, each as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each within its group from 0 on, and ``size`` of the group.

    ``group`` must not be null. Rows equal in ``order`` take places next to each other.
    """
    spark = rows.sparkSession
    numbered = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "row"]
    # The id of a row within its sorted partition rises with its place.
    ranged = stage(numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    whole = Window.partitionBy(group)
    runs = stage(ranged.groupBy(group, "part").agg(F.min("at").alias("low"), F.count("*").alias("held"))
                 .withColumn("before", F.sum("held").over(whole.orderBy("part")) - F.col("held"))
                 .withColumn("size", F.sum("held").over(whole)).drop("held"))
    small = runs.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    return (ranged.join(F.broadcast(runs) if small else runs, [group, "part"])
            .withColumn("pos", F.col("at") - F.col("low") + F.col("before"))
            .drop("row", "at", "part", "low", "before"))


NODE = "tree string, level int, pos long, size long, hash binary, seg binary"
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("size", pa.int64()),
                   ("hash", pa.binary()), ("seg", pa.binary())])


def _parent(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


def _climb(base: int, levels: int):
    """Nodes above one block of a tree, each with its sibling; the block's top node has its hash instead."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, size = table["tree"][0].as_py(), table["size"][0].as_py()
        place, now = table["pos"][0].as_py(), table["hash"].to_pylist()
        level, end = base, min(base + levels, (size - 1).bit_length())
        out: list[tuple] = []
        while level < end:
            last = -(-size // (1 << level)) - 1
            for i, _ in enumerate(now):
                sibling = now[i ^ 1] if place + i != last or i & 1 else b""
                out.append((tree, level, place + i, size, None, sibling))
            now = [_parent(now[i], now[i + 1] if i + 1 < len(now) else None) for i in range(0, len(now), 2)]
            place, level = place >> 1, level + 1
        out.append((tree, level, place, size, now[0], b""))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE, strict=True)], schema=_NODE)

    return run


def trees(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """Of ``leaves`` (``tree, pos, size, hash``): the nodes with their siblings as ``seg``, the roots as
    ``tree, size, hash``, and the levels of the highest tree."""
    top = leaves.agg(F.max("size")).first()[0] or 1
    depth = (top - 1).bit_length()
    nodes: list[DataFrame] = []
    now, base = leaves.select("tree", "pos", "size", "hash"), 0
    roots: list[DataFrame] = []
    while True:
        block = F.shiftright("pos", levels).alias("block")
        grown = stage(now.groupBy("tree", block).applyInArrow(_climb(base, levels), NODE))
        nodes.append(grown.where("hash is null").drop("hash"))
        base += levels
        tops = grown.where("hash is not null")
        done = F.col("size") <= 1 << base
        roots.append(tops.where(done).select("tree", "size", "hash"))
        if base >= depth:
            break
        now = tops.where(~done).select("tree", "pos", "size", "hash")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, roots), depth


def jumped(nodes: DataFrame, depth: int, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """``tree, pos, seg`` of every leaf: its siblings up to the root, from the lowest on."""
    now, step = nodes, 1
    while step < depth:
        above = now.where(F.col("level") % (2 * step) == step).select(
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.col("seg").alias("up_seg"))
        rows = max(1, small_bytes // (32 * step + 60))
        if above.limit(rows + 1).count() <= rows:
            above = F.broadcast(above)
        kept = now.where(F.col("level") % (2 * step) == 0)
        meets = ((F.col("tree") == F.col("up_tree")) & (F.col("level") + step == F.col("up_level"))
                 & (F.shiftright("pos", step) == F.col("up_pos")))
        now = stage(kept.join(above, meets, "left").select(
            "tree", "level", "pos", "size", F.concat("seg", F.coalesce("up_seg", F.lit(b""))).alias("seg")))
        step *= 2
    return now.where("level = 0").select("tree", "pos", "seg")


def folded(leaf_col: str, pos: str, size: str, seg: str) -> Column:
    """Root recomputed from a leaf (hex), its place, the size of its tree and its siblings."""
    sibling = f"lower(hex(substring({seg}, s.at, 32)))"
    return F.expr(f"""
      aggregate(
        if({size} > 1, sequence(0, cast(ceil(log2({size})) as int) + 1), array()),
        struct({leaf_col} as h, 1 as at),
        (s, l) -> if(
          shiftright({size} - 1, l) = 0, s,
          if((shiftright({pos}, l) ^ 1L) <= shiftright({size} - 1, l),
             struct(sha2(if((shiftright({pos}, l) & 1L) = 1L, concat({sibling}, s.h), concat(s.h, {sibling})), 256) as h, s.at + 32 as at),
             struct(sha2(s.h, 256) as h, s.at as at))),
        s -> s.h)""")


def manifest(rows: DataFrame, leaf_col: Column, group: Column, order: Column, carry: dict[str, Column] | None = None,
             levels: int = BLOCK_LEVELS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row per row of ``rows``: the columns of ``carry``, ``leaf``, ``pos`` and ``size`` in its group's
    tree, ``seg`` (binary: its siblings there, lowest first), ``subroot``, ``top_pos``, ``top_size`` and
    ``top_seg`` (the same for the tree over the groups, which stand in the order of ``group``, null first)
    and ``root``. All digests but the segments are hex text.

    Within a group rows stand in the order of ``order`` (nulls first), then of their leaves; equal rows
    are leaves of their own. A null group is a group. An empty table has no rows and no root.
    """
    carry = carry or {}
    marked = rows.select(*[c.alias(f"c_{k}") for k, c in carry.items()], leaf_col.alias("leaf"), order.alias("o"),
                         # A group's name sorts as the group does, and is never null.
                         F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0")).alias("tree"))
    base = stage(placed(marked, "tree", ["o", "leaf"]))
    leaves = base.select("tree", "pos", "size", F.unhex("leaf").alias("hash"))
    nodes, roots, depth = trees(leaves, levels)
    proofs = jumped(nodes, depth, small_bytes)
    groups = stage(placed(roots.select(F.col("tree").alias("name"), F.col("hash"), F.lit("").alias("tree")), "tree", ["name"]))
    top_nodes, top_roots, top_depth = trees(groups, levels)
    top_proofs = jumped(top_nodes, top_depth, small_bytes).select(F.col("pos").alias("p"), F.col("seg").alias("top_seg"))
    found = top_roots.select(F.lower(F.hex("hash"))).first()  # one row, or none
    tops = stage(groups.join(top_proofs, F.col("pos") == F.col("p"), "left").select(
        F.col("name").alias("tree"), F.lower(F.hex("hash")).alias("subroot"), F.col("pos").alias("top_pos"),
        F.col("size").alias("top_size"), F.coalesce("top_seg", F.lit(b"")).alias("top_seg"),
        F.lit(found[0] if found else None).cast("string").alias("root")))
    small = tops.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    whole = base.join(proofs, ["tree", "pos"], "left").join(F.broadcast(tops) if small else tops, "tree")
    return whole.select(*[F.col(f"c_{k}").alias(k) for k in carry], "leaf", "pos", "size", F.coalesce("seg", F.lit(b"")).alias("seg"),
                        "subroot", "top_pos", "top_size", "top_seg", "root")


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by ``lang`` and ``doc_id``, checked against a tampered copy in which
    ``n_chars`` is one more wherever 7 divides the crc32 of the decimal ``doc_id``.

    ``proof_sha256`` hashes the hex text of all siblings of a leaf, from its group's tree to the root.
    ``folded_root`` follows from the leaf of the tampered copy and the siblings of the manifest. A null
    ``doc_id`` or ``n_chars`` is never tampered with; a null field is part of its leaf as ``-``.
    """
    fields = {name: F.col(name) for name in FIELDS}
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + F.lit(1)}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = manifest(docs, leaf(list(fields.values())), F.col("lang"), F.col("doc_id"),
                     {"doc_id": F.col("doc_id"), "changed": F.when(hit, leaf(list(more.values())))})
    proof = F.sha2(F.lower(F.hex(F.concat("seg", "top_seg"))), 256)
    checked = (found.withColumn("seen", F.coalesce("changed", "leaf"))
               .withColumn("seen_subroot", folded("seen", "pos", "size", "seg"))
               .withColumn("folded_root", folded("seen_subroot", "top_pos", "top_size", "top_seg")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified"))
