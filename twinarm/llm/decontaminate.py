"""Benchmark passages in documents: an FM-index for each shard of documents, searched for all phrases.

A shard is a run of texts, or a stretch of one long text, of bounded bytes. Its words become numbers of
the benchmark's vocabulary; runs of known words too short for any phrase can't hold one and stay out of
the index. All phrases are searched backwards at once, their occurrences located through sampled
positions, and hit words merged into spans. Stretches of one text overlap by a phrase less one word, so
none is lost between them. The benchmark reaches the tasks in parts of bounded size, one at a time; with
more than one, the texts are written once with a row key, and each part gives back keys and spans only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words
from twinarm.llm.fm_index import FMIndex
from twinarm.llm.storage import stage

WINDOW = 13
#: Benchmark bytes that are broadcast at once; a larger benchmark takes several passes.
PART_BYTES = 8_000_000
#: Bytes of text in one index; its arrays take about 60 times as much.
SHARD_BYTES = 1_000_000
SEPARATOR = 1
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
#: First word, last word + 1, and the same in code points.
Span = tuple[int, int, int, int]


class Phrases:
    """Distinct windows of some benchmark items as numbers of their vocabulary (from 2 on)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        hashed = words.hash_list([text for _, text in items])
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        found: dict[tuple[int, ...], set[str]] = {}
        for (name, _), h in zip(items, hashed, strict=True):
            ids = (np.searchsorted(self.vocabulary, h) + 2).tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update([] if name is None else [name])
        keys = sorted(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.patterns = np.zeros((len(keys), int(self.lengths.max(initial=1))), np.int64)
        for row, k in enumerate(keys):
            self.patterns[row, : len(k)] = k
        self.items = [sorted(found[k]) for k in keys]

    def known_runs(self, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words in long enough runs, with a separator after each run; places in ``found``."""
        h = words.hashes(found)
        if not len(h) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        start, end = known.copy(), known.copy()
        start[1:] &= ~known[:-1]
        end[:-1] &= ~known[1:]
        edge = found.first[(found.first > 0) & (found.first < len(h))]
        start[edge] |= known[edge]
        end[edge - 1] |= known[edge - 1]
        a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
        keep = b - a >= self.shortest
        a, b = a[keep], b[keep]
        size = b - a + 1
        total = int(size.sum())
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        numbers = np.full(total, SEPARATOR, np.int64)
        inside = np.ones(total, bool)
        inside[np.cumsum(size) - 1] = False
        numbers[inside] = at[place[inside]] + 2
        return numbers, np.where(inside, place, -1)


class Shard(NamedTuple):
    """Words of the rows from ``row`` to ``stop``; for a stretch of one long text, how many words and
    code points of it come before."""

    row: int
    stop: int
    found: words.Words
    words_before: int = 0
    chars_before: int = 0


def _leads(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def shards(column: pa.Array, window: int, limit: int | None = None) -> Iterator[Shard]:
    """Cut a column of texts into shards of about ``limit`` bytes, longer texts into stretches that end
    between words and overlap by ``window - 1`` words. A word is never cut, however long."""
    limit = limit or SHARD_BYTES
    inside = words.CLASSES["alnum"]
    for row, stop, data, text_start in words.slices(column, limit):
        if len(data) <= limit:
            yield Shard(row, stop, words.split(data, text_start, "alnum"))
            continue
        begin = before = chars = 0
        size = limit
        while True:
            end = min(len(data), begin + size)
            while end < len(data):  # to the end of the word that stands here
                gaps = np.flatnonzero(~inside[words.lower(data[end : end + limit])])
                end = min(len(data), end + (int(gaps[0]) if len(gaps) else limit))
                if len(gaps):
                    break
            found = words.split(data[begin:end], np.array([0, end - begin]), "alnum")
            held = len(found.start)
            if end < len(data) and held < window:  # a shard must move on by a word at least
                size *= 2
                continue
            yield Shard(row, stop, found, before, chars)
            if end == len(data):
                break
            step = held - window + 1
            at = int(found.start[step]) if step < held else end - begin
            chars += int(np.count_nonzero(_leads(data[begin : begin + at])))
            before, begin, size = before + step, begin + at, limit


def _merge(spans: Iterable[Span]) -> list[Span]:
    """Union of word spans; their code points go with them."""
    out: list[Span] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            x, y, z, w = out[-1]
            out[-1] = (x, max(b, y), z, max(d, w))
        else:
            out.append((a, b, c, d))
    return out


def _occurrences(shard: Shard, phrases: Phrases) -> Iterator[tuple[int, list[Span], set[str]]]:
    """Merged spans and item names for each row of ``shard`` that holds a phrase."""
    found = shard.found
    numbers, at = phrases.known_runs(found)
    if not len(numbers):
        return
    index = FMIndex(numbers)
    low, high = index.search(phrases.patterns, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    if not len(which):
        return
    into = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
    first = at[index.locate(into)]
    last = first + phrases.lengths[which] - 1
    text = np.searchsorted(found.first, first, "right") - 1
    order = np.lexsort((first, text))
    for part in np.split(order, np.flatnonzero(np.diff(text[order])) + 1):
        t = int(text[part[0]])
        begin = int(found.text_start[t])
        before = np.cumsum(_leads(found.data[begin : int(found.text_start[t + 1])]))

        def char(place: np.ndarray, begin: int = begin, before: np.ndarray = before) -> np.ndarray:
            return np.where(place > begin, before[np.maximum(place - begin - 1, 0)], 0) + shard.chars_before

        words_at = first[part] - int(found.first[t]) + shard.words_before
        spans = zip(words_at.tolist(), (words_at + last[part] - first[part] + 1).tolist(),
                    char(found.start[first[part]]).tolist(), char(found.end[last[part]]).tolist(), strict=True)
        yield shard.row + t, _merge(spans), set().union(*(phrases.items[q] for q in np.unique(which[part]).tolist()))


def find(column: pa.Array, phrases: Phrases, limit: int | None = None) -> tuple[np.ndarray, dict[int, tuple[list[Span], set[str]]]]:
    """Words of each text, and for texts with hits their merged spans and item names. One shard is held
    at a time."""
    n_words = np.zeros(len(column), np.int64)
    hits: dict[int, tuple[list[Span], set[str]]] = {}
    for shard in shards(column, phrases.window, limit):
        n_words[shard.row : shard.stop] = np.diff(shard.found.first) + shard.words_before
        for row, spans, items in _occurrences(shard, phrases):
            old, names = hits.get(row, ([], set()))
            hits[row] = (_merge([*old, *spans]), names | items)
    return n_words, hits


SCHEMA = ("id long, n_words long, n_hit long, items array<string>, "
          "word_spans array<struct<start:long,end:long>>, char_spans array<struct<start:long,end:long>>")


def _rows(n: int, hits: dict[int, tuple[list[Span], set[str]]]) -> list[pa.Array]:
    """Columns from ``n_hit`` on."""
    n_hit = np.zeros(n, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    chars: list[list] = [[] for _ in range(n)]
    for row, (found, names) in hits.items():
        n_hit[row] = sum(b - a for a, b, _, _ in found)
        items[row] = sorted(names)
        spans[row] = [{"start": a, "end": b} for a, b, _, _ in found]
        chars[row] = [{"start": c, "end": d} for _, _, c, d in found]
    return [pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN)), pa.array(chars, pa.list_(SPAN))]


NAMES = ["id", "n_words", "n_hit", "items", "word_spans", "char_spans"]


def _scanner(shared):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits = find(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), *_rows(batch.num_rows, hits)], names=NAMES)

    return scan


PIECES = "key long, id long, n_words long, items array<string>, spans array<struct<a:long,b:long,c:long,d:long>>"
PIECE = pa.struct([(x, pa.int64()) for x in "abcd"])


def _part_scanner(shared, first: bool):
    """Rows with hits in one part of the benchmark; of the first part, every row."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits = find(batch.column(2), shared.value)
            rows = list(range(batch.num_rows)) if first else sorted(hits)
            found = [hits.get(r, ([], set())) for r in rows]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(n_words[rows]),
                 pa.array([sorted(names) for _, names in found], pa.list_(pa.string())),
                 pa.array([[dict(zip("abcd", s, strict=True)) for s in spans] for spans, _ in found], pa.list_(PIECE))],
                names=["key", "id", "n_words", "items", "spans"])

    return scan


def _join_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = {}
        for row, (items, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if spans:
                hits[row] = (_merge((s["a"], s["b"], s["c"], s["d"]) for s in spans), {x for x in items if x is not None})
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_rows(batch.num_rows, hits)], names=NAMES)


def phrase_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                 part_bytes: int = PART_BYTES) -> tuple[int, Callable[[int], Phrases]]:
    """How many parts of about ``part_bytes`` the benchmark has, and a function that collects one of them.

    Repeated rows are taken once; a text that many items share is spread over the parts by their ids.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))

    def part(k: int) -> Phrases:
        rows = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(parts)) == k).collect()
        return Phrases([(r["id"], r["text"]) for r in sorted(rows, key=str)], window)

    return parts, part


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """``id, n_words, n_hit, items, word_spans, char_spans`` of each row of ``docs``.

    A hit word stands inside an occurrence of a window of ``window`` consecutive words of an item (of
    the whole item, if that is shorter). Spans are merged, of words and of code points, end excluded.
    Null and empty texts have no words and no hits; items without words or with a null text have no
    window, items with a null id hit words without being named; equal rows are judged alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts, part = phrase_parts(benchmark, item_col, item_text_col, window, part_bytes)
    if parts == 1:
        return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(part(0))), SCHEMA)
    keyed = stage(rows.select(F.monotonically_increasing_id().alias("key"), "id", "text"))
    pieces = []
    for k in range(parts):
        shared = spark.sparkContext.broadcast(part(k))
        pieces.append(stage(keyed.mapInArrow(_part_scanner(shared, k == 0), PIECES)))
        shared.destroy()
    joined = reduce(DataFrame.unionByName, pieces).groupBy("key").agg(
        F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return joined.drop("key").mapInArrow(_join_pieces, SCHEMA)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
               part_bytes: int = PART_BYTES, hit_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """The rows of ``docs`` whose hit words stay below ``hit_share`` of their words, all columns kept.

    Null and empty texts have no hit and stay; equal rows stay or go together. A benchmark above
    ``part_bytes`` is judged part by part, with the documents written once under a row key.
    """
    spark = docs.sparkSession
    share, whole = hit_share
    parts, part = phrase_parts(benchmark, window=window, part_bytes=part_bytes)
    if parts == 1:
        shared, at = spark.sparkContext.broadcast(part(0)), docs.columns.index(text_col)

        def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hits = find(batch.column(at), shared.value)
                keep = np.ones(batch.num_rows, bool)
                for row, (spans, _) in hits.items():
                    keep[row] = sum(b - a for a, b, _, _ in spans) * whole < share * n_words[row]
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(pick, docs.schema)
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")))
    found = contamination(keyed.select("key", F.col("row")[text_col].alias("text")), benchmark, "key", "text",
                          window=window, part_bytes=part_bytes)
    bad = stage(found.where((F.col("n_hit") > 0) & (F.col("n_hit") * whole >= F.col("n_words") * share)).select("id"))
    return keyed.join(bad, keyed["key"] == bad["id"], "left_anti").select("row.*")
