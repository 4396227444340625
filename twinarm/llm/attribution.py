"""Token counts of the sections or fields of documents: each document is encoded once, as a whole.

Token spans and section spans are two sorted lists of the same bytes, so their interval join is a
merge by binary search. A token that crosses a border goes to sections by an explicit rule:
``start``: to the section of its first byte; ``majority``: to the section with most of its bytes, the
earlier one at a tie; ``split``: to every section by its share of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.tokens import default_path, encoder

RULES = ("start", "majority", "split")


def allocate(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens it shares with others.

    ``sizes`` are bytes of tokens, ``ends`` the last byte + 1 of consecutive sections (not falling; the
    last is the sum of ``sizes``). An empty section has no token.
    """
    token_end = np.cumsum(sizes)
    token_start = token_end - sizes
    first = np.concatenate([[0], ends[:-1]])
    counts = np.diff(np.searchsorted(token_start, np.concatenate([[0], ends])), prepend=0)[1:].astype(np.float64)
    crossing = np.zeros(len(ends), np.int64)
    inner = ends[:-1]
    at = np.searchsorted(token_end, inner, "right")
    cut = at[(at < len(sizes)) & (token_start[np.minimum(at, len(sizes) - 1)] < inner)] if len(sizes) else at[:0]
    for token in np.unique(cut).tolist():
        a, b = token_start[token], token_end[token]
        part = np.minimum(ends, b) - np.maximum(first, a)
        held = np.flatnonzero(part > 0)
        crossing[held] += 1
        if rule != "start":
            counts[held[0]] -= 1
            if rule == "majority":
                counts[held[np.argmax(part[held])]] += 1
            else:
                counts[held] += part[held] / (b - a)
    return counts, crossing


def _ends(parts: list[bytes]) -> np.ndarray:
    return np.cumsum([len(p) for p in parts])


def section_parts(text: str, separator: str) -> list[str]:
    """Sections of a text; a separator ends the section before it. An empty text is one section."""
    parts = [p + separator for p in text.split(separator)]
    parts[-1] = parts[-1][: len(parts[-1]) - len(separator)]
    return parts[:-1] if len(parts) > 1 and not parts[-1] else parts


SCHEMA = "id long, section int, start long, end long, n_tokens double, n_crossing long"


def _attributor(parts_of, path: str, rule: str):
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        lengths = known.byte_lengths
        for batch in batches:
            rows, section, start, end, count, crossing = [], [], [], [], [], []
            for row, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                parts = parts_of(values)
                sizes = lengths[np.array(known.ids("".join(parts)), np.int64)]
                counts, crossed = allocate(sizes, _ends([p.encode() for p in parts]), rule)
                chars = np.cumsum([len(p) for p in parts])
                rows += [row] * len(parts)
                section += range(len(parts))
                end += chars.tolist()
                start += [0, *chars[:-1].tolist()]
                count += counts.tolist()
                crossing += crossed.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(section, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(count, pa.float64()), pa.array(crossing, pa.int64())],
                names=["id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n",
                   rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """One row per section of each row: its place, its code point span, its tokens, and how many of the
    document's tokens lie partly in it. A null or empty text is one empty section without tokens.

    The tokens of a document's sections add up to those of the whole text, under every rule. Equal rows
    give equal rows; ids are carried as they are. Needs a byte-level vocabulary.
    """
    if not separator:
        raise ValueError("a separator is needed")
    run = _attributor(lambda v: section_parts(v[0] or "", separator), tokenizer or default_path(), rule)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)


def field_tokens(rows: DataFrame, fields: list[str], id_col: str = "doc_id", joiner: str = "\n", rule: str = "start",
                 tokenizer: str | None = None) -> DataFrame:
    """As ``section_tokens``, with the named columns, joined by ``joiner``, as sections in their order.
    A joiner belongs to the field before it; a null field is empty."""
    def parts_of(values: tuple) -> list[str]:
        return [(v or "") + (joiner if i + 1 < len(values) else "") for i, v in enumerate(values)]

    run = _attributor(parts_of, tokenizer or default_path(), rule)
    return rows.select(F.col(id_col).cast("long").alias("id"),
                       *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]).mapInArrow(run, SCHEMA)
