"""Quality of texts by a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins. Boosting goes round the features, one after another, and
fits a shallow tree on one feature's bins to what is still unexplained; a feature's trees add up to one
lookup table. Then the pairs of features with the largest remaining interaction get tables of their
own in the same way. A score is a sum of looked-up numbers, for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words

#: Labelled rows whose features are collected to fit the model; a hash of id and text picks them.
SAMPLE = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_ROUNDS = 48, 250, 0.08, 4, 8, 80
#: Hessian added to every leaf.
RIDGE = 2.0
THRESHOLD = 0.7

FEATURES = ("log_bytes", "spaces", "lines", "stops", "commas", "symbols", "digits", "capitals", "high", "log_words",
            "word_length", "long_words", "short_words", "distinct", "top_word", "repeated", "hapax", "distinct_pairs",
            "line_length", "repeated_lines", "marked_words")

_SPACE, _STOP, _COMMA, _DIGIT, _CAPITAL, _LOW, _SYMBOL = (np.zeros(256, bool) for _ in range(7))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[33, 46, 63]] = True
_COMMA[[44, 58, 59]] = True
_DIGIT[48:58] = True
_CAPITAL[65:91] = True
_LOW[97:123] = True
_SYMBOL[33:127] = True
_SYMBOL[_STOP | _COMMA | _DIGIT | _CAPITAL | _LOW] = False


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all zeros for a null or empty one."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, stop, data, text_start in words.slices(column):
        found = words.split(data, text_start, "spaced")
        h = words.hashes(found)
        size = np.diff(text_start)
        n_words = np.diff(found.first)

        def share(mask: np.ndarray, data=data, text_start=text_start, size=size) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask[data])])
            return (sums[text_start[1:]] - sums[text_start[:-1]]) / np.maximum(size, 1)

        def mean(values: np.ndarray, found=found, n_words=n_words) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return (sums[found.first[1:]] - sums[found.first[:-1]]) / np.maximum(n_words, 1)

        length = found.end - found.start
        same = np.zeros(len(h))
        same[1:] = h[1:] == h[:-1]
        marked = np.zeros(len(h))
        if len(h):  # words that end in two marks or in a symbol
            last = data[found.end - 1]
            marked = (_SYMBOL[last] | ((length > 1) & ~_LOW[last] & (last < 128) & (data[found.end - 2] == last))).astype(float)
        block = out[row:stop]
        block[:, 0] = np.log1p(size)
        for k, mask in ((1, _SPACE), (3, _STOP), (4, _COMMA), (5, _SYMBOL), (6, _DIGIT), (7, _CAPITAL)):
            block[:, k] = share(mask)
        newline, high = np.zeros(256, bool), np.zeros(256, bool)
        newline[10], high[128:] = True, True
        block[:, 2], block[:, 8] = share(newline), share(high)
        block[:, 9] = np.log1p(n_words)
        block[:, 10], block[:, 11], block[:, 12] = mean(length), mean(length > 12), mean(length < 4)
        block[:, 15], block[:, 20] = mean(same), mean(marked)
        pairs = words.mix(h[:-1] + words.mix(h[1:])) if len(h) else h
        for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
            if a == b:
                continue
            counts = np.unique(h[a:b], return_counts=True)[1]
            block[i, 13] = len(counts) / (b - a)
            block[i, 14] = counts.max() / (b - a)
            block[i, 16] = np.count_nonzero(counts == 1) / (b - a)
            block[i, 17] = len(np.unique(pairs[a : b - 1])) / max(1, b - a - 1)
        for i, (a, b) in enumerate(zip(text_start[:-1].tolist(), text_start[1:].tolist(), strict=True)):
            if a < b:
                lines = [x for x in data[a:b].tobytes().split(b"\n") if x]
                block[i, 18] = np.log1p((b - a) / max(1, len(lines)))
                block[i, 19] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return out


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    b = binned(x, model.edges)
    z = np.full(len(x), model.base)
    for j, table in enumerate(model.tables):
        z += table[b[:, j]]
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        z += table[b[:, i], b[:, j]]
    return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton step of each bin by a tree that splits the bins' range where that gains most."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)

    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                k = np.arange(a + 1, b)
                won = gain(a, k) + gain(k, b) - gain(a, b)
                if won.max() > best:
                    best, at = won.max(), int(k[won.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return step


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a table into four by one border on each side: its gain and its steps."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(t, 0), 1), ((1, 0), (1, 0))) for t in (g, h))

    def part(c, k):
        top, left, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        inner = c[1:-1, 1:-1]
        return (inner, top - inner, left - inner, all_ - top - left + inner)[k]

    quads = [(part(cg, k), part(ch, k)) for k in range(4)]
    won = sum(a**2 / (b + RIDGE) for a, b in quads)
    if not won.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(won.argmax(), won.shape)
    step = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                      (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        a, b = quads[k][0][i, j], quads[k][1][i, j]
        step[rows, cols] = a / (b + RIDGE)
    return float(won.max()), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS,
        pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    rate_one = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_one / (1 - rate_one)))
    b = binned(x, edges)
    size = [len(e) + 1 for e in edges]
    tables = [np.zeros(n) for n in size]
    z = np.full(len(y), base)
    if len(y):
        for _ in range(rounds):
            for j in range(len(tables)):
                p = 1 / (1 + np.exp(-z))
                step = rate * _tree(np.bincount(b[:, j], y - p, size[j]), np.bincount(b[:, j], p * (1 - p), size[j]), LEAVES)
                tables[j] += step
                z += step[b[:, j]]

    def table(i, j, values):
        return np.bincount(b[:, i] * size[j] + b[:, j], values, size[i] * size[j]).reshape(size[i], size[j])

    p = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(len(size) if len(y) else 0):
        for j in range(i + 1, len(size)):
            gains.append((_square(table(i, j, y - p), table(i, j, p * (1 - p)))[0], i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    pair_tables = [np.zeros((size[i], size[j])) for i, j in chosen]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(chosen):
            p = 1 / (1 + np.exp(-z))
            step = rate * _square(table(i, j, y - p), table(i, j, p * (1 - p)))[1]
            pair_tables[k] += step
            z += step[b[:, i], b[:, j]]
    return Model(base, edges, tables, chosen, pair_tables)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0))
        flat = pa.array(x.ravel())
        ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(ends, flat)], names=["y", "x"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of ``labelled`` (whole texts, labels 0 and 1; null labels are left
    out). Only their features reach the driver. Without rows every text scores one half."""
    rows = labelled.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"),
                           F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key")).where("y in (0, 1)")
    n = rows.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    # Repeated rows share a key: one of them teaches what all of them do, and the sample stays bounded.
    picked = rows.where(F.pmod("key", F.lit(1 << 30)) < share).dropDuplicates(["key", "y"]).select("text", "y")
    found = picked.mapInArrow(_features, "y int, x array<double>").toArrow()
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if found.num_rows else np.zeros((0, len(FEATURES)))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # whatever the order in which tasks end
    return fit(x[order], y[order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row; null and empty texts are scored as texts without bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, features(batch.column(1))))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, score double")


def good_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that score at least ``threshold``, all columns kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(shared.value, features(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
