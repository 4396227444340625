"""Words of many texts at once: spans and 64-bit hashes by numpy over the bytes of Arrow columns.

Both word classes used here are sets of bytes in UTF-8 (every byte from 0x80 on belongs to a word),
so word borders can be found without decoding. A word's hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporary arrays take about 60 times as much.
SLICE_BYTES = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def _byte_class(kind: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x80:] = True
    if kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        table[0x30:0x3A] = table[0x61:0x7B] = True
    elif kind == "spaced":  # [^\x20\x09-\x0D]+
        table[:0x80] = True
        table[0x20] = False
        table[0x09:0x0E] = False
    else:
        raise ValueError(kind)
    return table


CLASSES = {kind: _byte_class(kind) for kind in ("alnum", "spaced")}


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]


class Words(NamedTuple):
    """Words of consecutive texts. ``first[d]:first[d + 1]`` are those of text ``d``."""

    data: np.ndarray  # bytes, lower-cased
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray  # place of each text in ``data``, one more at the end


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes; a longer text stays whole.

    Yields first row, last row + 1, the bytes, and the place of each text in them. Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offset, offset[row] + limit, "right")) - 1)
        yield row, stop, data[offset[row] : offset[stop]], offset[row : stop + 1] - offset[row]
        row = stop


def split(data: np.ndarray, text_start: np.ndarray, kind: str) -> Words:
    """Lower-case A-Z and find the words of each text."""
    data = lower(data)
    inside = CLASSES[kind][data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = text_start[(text_start > 0) & (text_start < len(data))]
        begins[borders] |= inside[borders]
        ends[borders - 1] |= inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, text_start), text_start)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of ``x`` over all bits of the result (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: Words) -> np.ndarray:
    """One uint64 a word: a polynomial of its bytes, by prefix sums, then mixed."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(words.data))
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[words.data] * up[:-1], out=sums[1:])
    raw = (sums[words.end] - sums[words.start]) * down[words.start]
    return mix(raw + (words.end - words.start).astype(np.uint64))


def hash_list(texts: list[str], kind: str = "alnum") -> list[np.ndarray]:
    """Word hashes of a few texts."""
    out: list[np.ndarray] = []
    for _, _, data, places in slices(pa.array(texts, pa.string())):
        found = split(data, places, kind)
        values = hashes(found)
        out += [values[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return out


def shingles(values: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n = len(values)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = mix(rolled + values[k : n - width + 1 + k])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h + values[k : k + 1])
            yield h
        else:
            yield rolled[:0]
