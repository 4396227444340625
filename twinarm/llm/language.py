"""Language of texts by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``ORDER`` long counts what follows. A byte costs the
code length of its count in the longest context that has seen it; each longer context that has not
costs an escape (method C: as many escapes as different followers). The counts are frozen after
training, so the cost of every byte string in every language is one row of a table, and a text costs
the sum of its rows. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words
from twinarm.llm.storage import bound_batches

ORDER = 3
#: Training documents for each language; a hash of id and text picks them where there are more.
SAMPLE = 2000
#: A text that costs more bits a byte than this in every language is like none of them, if it does so
#: by SURE_BITS in all: a short text with one odd word in it does not.
MOST_BITS, SURE_BITS = 6.0, 512.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """For every byte, itself and the ``ORDER`` bytes before as one number; spaces stand before a text.

    Letters are lower-cased; other ASCII characters count as spaces.
    """
    folded = _FOLD[data]
    n_texts = len(text_start) - 1
    padded = np.full(len(data) + ORDER * n_texts, 32, np.uint8)
    lengths = np.diff(text_start)
    place = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, n_texts + 1), lengths)
    padded[place] = folded
    code = np.zeros(len(padded), np.uint32)
    for back in range(ORDER + 1):
        code[back:] |= padded[: len(padded) - back].astype(np.uint32) << np.uint32(8 * back)
    return code[place]


class Model(NamedTuple):
    """``seen[k]``: sorted strings of k + 1 bytes, ``cost[k]``: their bits in each language.
    ``contexts[k]``, ``escape[k]``: the same for what leaving a context of k bytes costs."""

    languages: list[str]
    seen: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


def fit_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Code length tables from counts of the longest strings (distinct numbers, counts) by language."""
    languages = sorted(counts)
    model = Model(languages, [], [], [], [])
    mask = [np.uint32((1 << 8 * (k + 1)) - 1) for k in range(ORDER)] + [np.uint32(0xFFFFFFFF)]
    for k in range(ORDER + 1):
        strings = np.unique(np.concatenate([counts[x][0] & mask[k] for x in languages]))
        n = np.zeros((len(strings), len(languages)))
        for j, x in enumerate(languages):
            np.add.at(n[:, j], np.searchsorted(strings, counts[x][0] & mask[k]), counts[x][1])
        # Bytes of a number: the last byte lowest, so a context is the number without it.
        contexts, of = np.unique(strings >> np.uint32(8), return_inverse=True)
        total, different = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, of, n)
        np.add.at(different, of, n > 0)
        whole = np.maximum(total + different, 1)
        with np.errstate(divide="ignore"):
            escape = np.where(total > 0, -np.log2(different / whole), 0.0)
            hit = -np.log2(n / whole[of])
        lower = _cost(model, strings & (mask[k - 1] if k else np.uint32(0xFF)), k - 1)
        model.seen.append(strings)
        model.cost.append(np.where(n > 0, hit, escape[of] + lower).astype(np.float32))
        model.contexts.append(contexts)
        model.escape.append(escape.astype(np.float32))
    return model


def _cost(model: Model, codes: np.ndarray, order: int) -> np.ndarray:
    """Bits of the last byte of each string of ``order + 1`` bytes, in each language."""
    out = np.zeros((len(codes), len(model.languages)), np.float32)
    todo, now = np.arange(len(codes)), codes
    for k in range(order, -1, -1):
        seen = model.seen[k]
        at = np.minimum(np.searchsorted(seen, now), len(seen) - 1)
        hit = seen[at] == now
        out[todo[hit]] += model.cost[k][at[hit]]
        todo, now = todo[~hit], now[~hit]
        if not len(todo):
            return out
        context = now >> np.uint32(8)
        at = np.minimum(np.searchsorted(model.contexts[k], context), len(model.contexts[k]) - 1)
        known = model.contexts[k][at] == context
        out[todo[known]] += model.escape[k][at[known]]
        now = now & np.uint32((1 << 8 * k) - 1 if k else 0)
    out[todo] += 8.0
    return out


def score(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each text in each language, its bytes, and whether it has letters."""
    n = len(column)
    bits, size, letters = np.zeros((n, len(model.languages))), np.zeros(n, np.int64), np.zeros(n, bool)
    for row, stop, data, text_start in words.slices(column):
        size[row:stop] = np.diff(text_start)
        sums = np.concatenate([[0], np.cumsum(_LETTER[data])])
        letters[row:stop] = sums[text_start[1:]] > sums[text_start[:-1]]
        for i in np.flatnonzero(~letters[row:stop] & (size[row:stop] > 0)).tolist():
            letters[row + i] = any(map(str.isalpha, data[text_start[i] : text_start[i + 1]].tobytes().decode("utf-8", "replace")))
        if model.languages and len(data):
            cost = _cost(model, grams(data, text_start), ORDER)
            filled = np.flatnonzero(np.diff(text_start) > 0)
            bits[row + filled] = np.add.reduceat(cost, text_start[filled], axis=0, dtype=np.float64)
    return bits, size, letters


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of each language of ``labelled`` (whole texts); null labels and null
    texts are left out. What reaches the driver is the distinct strings of that sample."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [], [], [], [])
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample / n) * (1 << 30))))])
    picked = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share[F.col("lang")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(0).filter(pa.array(langs == lang))
                for _, _, data, text_start in words.slices(texts):
                    codes, n = np.unique(grams(data, text_start), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "code", "n"])

    found = (picked.select("text", "lang").mapInArrow(count, "lang string, code long, n long")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow())
    lang = np.array(found.column("lang").to_pylist(), object)
    code, n = found.column("code").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    return fit_counts({x: (code[lang == x], n[lang == x]) for x in sorted(set(lang))})


def decide(model: Model, column: pa.Array, most_bits: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior under equal priors, and whether the text is like that language at all."""
    bits, size, letters = score(model, column)
    known = letters & bool(model.languages)
    if not model.languages:
        return [UNKNOWN] * len(size), np.zeros(len(size)), known
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(size)), best]
    posterior = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(axis=1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return names, np.where(known, posterior, 0.0), known & (low <= most_bits * size + SURE_BITS)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row. Null texts and texts without a letter are ``und`` with
    score 0; equal texts get equal results; a tie goes to the first language by name. Without any
    training row every text is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, posterior, _ = decide(shared.value, batch.column(1), MOST_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(posterior)],
                                             names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, lang_pred string, score double")


def known_rows(docs: DataFrame, model: Model, text_col: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """Rows whose text is in one of the learned languages, all columns kept."""
    shared, at = bound_batches(docs.sparkSession).sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(shared.value, batch.column(at), most_bits)[2]))

    return docs.mapInArrow(run, docs.schema)
