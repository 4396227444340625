"""License notices in texts: templates with optional and replaceable regions, as token automata.

A template is written as text with two kinds of markup: ``[[...]]`` may be missing, and ``{{a,b}}``
stands for any ``a`` to ``b`` words. Everything else is mandatory wording, compared word by word,
without regard to case and punctuation. Templates compile to automata over words; a text matches
where an automaton accepts some stretch of it. Only texts that hold a mandatory word of some
template are looked at word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm import words

#: Label and words of the base phrases.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Public license notices as templates.
TEMPLATES = {
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at {{4,12}} Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "apache-2.0-notice": "[[This {{1,6}} is]] [[distributed and]] licensed under the [[terms of the]] Apache License [[Version]] 2.0",
    "bsd-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: [[1.]] Redistributions of source code must retain the [[above]]
        copyright notice [[unmodified]], this list of conditions and the following disclaimer. [[2.]] Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
    "cc-notice": """[[This {{1,6}} is]] licensed under [[a]] [[the]] [[terms of the]] [[Creative Commons]] CC BY [[NC]] [[ND]]
        [[SA]] {{1,1}} 0 [[International]] [[License]]""",
    "gpl-notice": """[[This {{1,6}} is]] [[free software]] licensed under the [[terms of the]] GNU [[Lesser]] [[Affero]] General
        Public License [[as published by the Free Software Foundation]] [[either]] version {{1,1}}""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version {{1,2}} of the License, or
        (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-notice": "[[This {{1,6}} is]] released under the [[terms of the]] MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
        copies or substantial portions of the Software.""",
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{\s*(\d+)\s*,\s*(\d+)\s*\}\}")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def parse(template: str) -> list:
    """Nested list of a template: words, ``(least, most)`` pairs, and lists for optional regions."""
    stack: list[list] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += text_words(template[at : mark.start()])
        at = mark.end()
        if mark[0] == "[[":
            stack.append([])
        elif mark[0] == "]]":
            if len(stack) == 1:
                raise ValueError("]] without [[")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            least, most = int(mark[1]), int(mark[2])
            if least > most:
                raise ValueError(f"{mark[0]} allows nothing")
            stack[-1].append((least, most))
    stack[-1] += text_words(template[at:])
    if len(stack) > 1:
        raise ValueError("[[ without ]]")
    return stack[0]


class Automaton:
    """Steps from state to state over words; None stands for any word. State 0 is the start."""

    def __init__(self, template: str):
        parts = parse(template)
        self.mandatory = [p for p in parts if isinstance(p, str)]
        if not self.mandatory:
            raise ValueError("a template needs mandatory words")
        self.steps: list[dict[str | None, set[int]]] = [{}]
        self.skips: list[set[int]] = [set()]
        self.final = self._add(parts, 0)
        self.starts = self._closed({0})
        self.first = {w for s in self.starts for w in self.steps[s]}
        if None in self.first or self.final in self.starts:
            raise ValueError("a template can't begin with a replaceable region")

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append(set())
        return len(self.steps) - 1

    def _add(self, parts: list, state: int) -> int:
        for part in parts:
            if isinstance(part, list):
                end = self._add(part, state)
                after = self._state()
                self.skips[state].add(after)
                self.skips[end].add(after)
                state = after
            elif isinstance(part, tuple):
                least, most = part
                ends = [state] if not least else []
                for k in range(1, most + 1):
                    new = self._state()
                    self.steps[state].setdefault(None, set()).add(new)
                    state = new
                    if k >= least:
                        ends.append(state)
                after = self._state()
                for end in ends:
                    self.skips[end].add(after)
                state = after
            else:
                new = self._state()
                self.steps[state].setdefault(part, set()).add(new)
                state = new
        return state

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts_from(self, found: list[str], at: int) -> int | None:
        """End of the shortest accepted stretch that begins at ``at``."""
        now = self.starts
        while at < len(found):
            new: set[int] = set()
            for s in now:
                step = self.steps[s]
                new |= step.get(found[at], set()) | step.get(None, set())
            if not new:
                return None
            now = self._closed(new)
            at += 1
            if self.final in now:
                return at
        return None


class Scanner:
    """All automata and base phrases together."""

    def __init__(self, templates: dict[str, str], base: dict[str, str]):
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        self.base = {label: text_words(p) for label, p in base.items()}
        gates = {max(a.mandatory, key=len) for a in self.automata.values()} | {max(p, key=len) for p in self.base.values()}
        self.gates = np.sort(np.concatenate(words.hash_list(sorted(gates))))

    def scan(self, found: list[str]) -> tuple[int, int | None, int | None, list[str], list[str]]:
        """Base places, their first and last word, base labels, template labels."""
        places, base, own = [], set(), set()
        for at, word in enumerate(found):
            for label, phrase in self.base.items():
                if word == phrase[0] and found[at : at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
            for label, automaton in self.automata.items():
                if label not in own and word in automaton.first and automaton.accepts_from(found, at) is not None:
                    own.add(label)
        return len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(own)


SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: number of words, base phrase places, labels, and a score of 1 with
    a matching template, 0.5 with base phrases alone, 0 otherwise.

    Null and empty texts have no words: zero counts, null places, empty labels. Every place counts,
    whole texts are read, and equal rows get equal results. Other columns are not read.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, BASE if base is None else base)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words: list[int] = []
            results: list[tuple] = []
            for _, _, data, text_start in words.slices(batch.column(1)):
                found = words.split(data, text_start, "alnum")
                n_words += np.diff(found.first).tolist()
                h = words.hashes(found)
                at = np.minimum(np.searchsorted(scanner.gates, h), len(scanner.gates) - 1)
                gated = np.concatenate([[0], np.cumsum(scanner.gates[at] == h)])
                look = gated[found.first[1:]] > gated[found.first[:-1]]
                for row, on in enumerate(look.tolist()):
                    if on:
                        a, b = found.first[row], found.first[row + 1]
                        base_at = text_start[row]
                        raw = found.data[base_at : text_start[row + 1]].tobytes()
                        tokens = [raw[s - base_at : e - base_at].decode("utf-8", "replace")
                                  for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)]
                        results.append(scanner.scan(tokens))
                    else:
                        results.append((0, None, None, [], []))
            n, low, high, base_labels, own = zip(*results, strict=True) if results else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(high, pa.int64()), pa.array([",".join(x) for x in base_labels], pa.string()),
                 pa.array([",".join(sorted({*x, *y})) for x, y in zip(base_labels, own, strict=True)], pa.string()),
                 pa.array([1.0 if y else 0.5 if x else 0.0 for x, y in zip(base_labels, own, strict=True)], pa.float64())],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def as_regex(template: str) -> str:
    """The template as a regular expression over `` word word `` (a space on both sides of each word)."""

    def render(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, list):
                out += f"(?:{render(part)})?"
            elif isinstance(part, tuple):
                out += f"(?: [^ ]+){{{part[0]},{part[1]}}}"
            else:
                out += " " + part
        return out

    return render(parse(template)) + " "
