"""Documents packed into as few sequences as possible by a grouping genetic algorithm on islands.

Texts become token ids once. Documents longer than a sequence are cut from the end, so that only the
first piece may be short; full pieces are sequences already. The rest is dealt to islands of bounded
size. An island starts from best fit over falling lengths and over shuffled orders. Crossover puts
whole well-filled bins of one solution into another, removes the bins that hold the same documents,
and fits the displaced documents into the best remaining room. Between rounds the best bins migrate
to the next island as lists of lengths, and are built there from documents of these lengths. At the
end the poorly filled bins of all islands are opened and packed again together, until that gains
nothing. An island that has reached the lower bound of its number of bins rests.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.storage import stage
from twinarm.llm.tokens import default_path, encoder

LENGTH = 1024
END_ID = 2
#: Documents of an island.
ISLAND = 4096
ROUNDS, GENERATIONS, POPULATION, ELITES = 2, 12, 6, 64
#: Bins filled to less than this are packed again across islands.
POOR = 0.97
LEVELS = 6

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, length: int, end_id: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        last = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[int] = []
            piece: list[int] = []
            start: list[int] = []
            size: list[int] = []
            crc: list[int] = []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + last)
                n = len(ids) // 4
                at, stop, k = 0, n % length or min(n, length), 0
                while at < n:
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    size.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, stop, k = stop, stop + length, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


class Bins:
    """Open bins by free room; a bit mask of the rooms that occur finds the best fit at once."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.items: list[list[int]] = []
        self.room: dict[int, list[int]] = defaultdict(list)

    def open(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.room[free].append(len(self.items) - 1)
        self.mask |= 1 << free

    def fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.open([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        at = self.room[free].pop()
        if not self.room[free]:
            self.mask ^= 1 << free
        self.items[at].append(item)
        self.room[free - size].append(at)
        self.mask |= 1 << (free - size)


def best_fit(order: Iterable[int], sizes: list[int], capacity: int, begin: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for items in begin:
        bins.open(list(items), capacity - sum(sizes[i] for i in items))
    for i in order:
        bins.fit(i, sizes[i])
    return bins.items


def inject(solution: list[list[int]], guests: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """``solution`` with the bins ``guests`` in it: bins that hold their items go, what else was in
    those is fitted into the best room, longest first."""
    taken = {i for b in guests for i in b}
    stay, displaced = [], []
    for b in solution:
        if taken.isdisjoint(b):
            stay.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, guests + stay)


def fitness(solution: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of fills."""
    return -len(solution), sum(sum(sizes[i] for i in b) ** 2 for b in solution) / (len(solution) * capacity**2)


def build(patterns: list[tuple[int, ...]], sizes: list[int]) -> list[list[int]]:
    """Bins of the lengths in ``patterns``, as far as there are items of these lengths."""
    free: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        free[s].append(i)
    out = []
    for pattern in patterns:
        picked: list[int] = []
        for s in pattern:
            if not free[s]:
                break
            picked.append(free[s].pop())
        if len(picked) == len(pattern):
            out.append(picked)
        else:
            for i in picked:
                free[sizes[i]].append(i)
    return out


def evolve(sizes: list[int], capacity: int, seed: int, begin: list[list[int]] | None = None,
           patterns: list[tuple[int, ...]] = (), generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """Best packing found for one island."""
    bound = -(-sum(sizes) // capacity)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best = best_fit(falling, sizes, capacity)
    rng = np.random.default_rng(seed)
    pool = [best] if begin is None else [begin, best]
    if min(len(s) for s in pool) > bound:
        if patterns and (guests := build(patterns, sizes)):
            pool.append(inject(pool[0], guests, sizes, capacity))
        while len(pool) < population:
            pool.append(best_fit(rng.permutation(len(sizes)).tolist(), sizes, capacity))
        score = [fitness(s, sizes, capacity) for s in pool]
        for _ in range(generations):
            if -max(score)[0] <= bound:
                break
            a, b = rng.choice(len(pool), 2, replace=False)
            host, donor = (a, b) if score[a] >= score[b] else (b, a)
            full = sorted(pool[donor], key=lambda x: -sum(sizes[i] for i in x))
            full = full[: max(1, len(full) // 2)]
            guests = [full[i] for i in rng.choice(len(full), max(1, len(full) // 3), replace=False)]
            child = inject(pool[host], guests, sizes, capacity)
            new, worst = fitness(child, sizes, capacity), min(range(len(pool)), key=score.__getitem__)
            if new > score[worst]:
                pool[worst], score[worst] = child, new
        best = pool[max(range(len(pool)), key=score.__getitem__)]
    else:
        best = min(pool, key=len)
    return best


STATE = "uid long, " + PIECES + ", island long, bin int, offset long, fill long, pattern array<int>"
_FIELDS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("island", pa.int64()), ("bin", pa.int32()),
                     ("offset", pa.int64()), ("fill", pa.int64()), ("pattern", pa.list_(pa.int32()))])


def _islander(capacity: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        is_item = pa.compute.is_valid(table.column("uid"))
        items = table.filter(is_item).sort_by("uid")
        patterns = [tuple(p) for p in table.filter(pa.compute.invert(is_item)).column("pattern").to_pylist()]
        if not items.num_rows:
            return _FIELDS.empty_table()
        sizes = items.column("length").to_pylist()
        before = items.column("bin").to_pylist()
        begin = None
        if None not in before:
            held: dict[int, list[int]] = defaultdict(list)
            for i, b in enumerate(before):
                held[b].append(i)
            begin = list(held.values())
        island = items.column("island")[0].as_py()
        solution = evolve(sizes, capacity, seed + island, begin, sorted(patterns))
        bins, offset, fill = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, b in enumerate(solution):
            total = sum(sizes[i] for i in b)
            at = 0
            for i in b:
                bins[i], offset[i], fill[i] = k, at, total
                at += sizes[i]
        out = items.select(["uid", "doc_id", "piece", "start", "length", "ids_crc32", "island"])
        for name, values in (("bin", bins), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(values))
        out = out.append_column("pattern", pa.nulls(len(sizes), pa.list_(pa.int32()))).cast(_FIELDS)
        elite = sorted(solution, key=lambda b: (-sum(sizes[i] for i in b), len(b)))[:ELITES]
        guests = pa.Table.from_pylist(
            [{"island": island, "pattern": sorted((sizes[i] for i in b), reverse=True)} for b in elite], schema=_FIELDS)
        return pa.concat_tables([out, guests])

    return run


def _deal(items: DataFrame, level: int, size: int) -> tuple[DataFrame, int]:
    islands = max(1, -(-items.count() // size))
    dealt = items.withColumn("island", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands)).cast("long"))
    return dealt.withColumn("bin", F.lit(None).cast("int")), islands


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
         tokenizer: str | None = None, island: int = ISLAND, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    A document is its ids and ``end_id``; null and empty texts are that id alone. Equal rows are
    packed as often as they occur; ids are carried as they are, null too. No rows give no rows.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = picked.mapInArrow(_cutter(tokenizer or default_path(), length, end_id), PIECES)
    pieces = stage(pieces.withColumn("uid", F.monotonically_increasing_id()))
    state = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "island", "bin", "offset", "fill", "pattern"]
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "long"), ("fill", "long"), ("pattern", "array<int>"))]
    out = pieces.where(F.col("length") == length).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < length)
    for level in range(LEVELS):
        dealt, islands = _deal(items, level, island)
        now = dealt.select(*[c for c in state if c not in ("offset", "fill", "pattern")], *blank)
        for step in range(rounds if islands > 1 else 1):
            now = stage(now.groupBy("island").applyInArrow(_islander(length, seed + 1000 * step), STATE))
            if step + 1 < rounds and islands > 1:  # the best bins travel to the next island
                moved = now.where("pattern is not null").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
                now = now.where("uid is not null").unionByName(moved)
        now = now.where("uid is not null")
        again = level + 1 < LEVELS and islands > 1
        done = now.where(F.col("fill") >= POOR * length) if again else now
        out = out.unionByName(done.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.lit(level * (1 << 56)) + F.col("island") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if not again:
            break
        items = now.where(F.col("fill") < POOR * length)
    return out
