"""Conversations as training windows: turn-aligned spans under a token budget, with a loss mask.

A turn is written as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Inside roles and texts a
``<`` followed by backslashes and a bar gets one more backslash, so no text can spell a control
string, and taking one backslash away gives the text back. A window repeats the system turn and the
last turns before it, up to a history budget; what is repeated is never a target again, so every
assistant text is a target exactly once.

Long conversations are cut into blocks of turns that are formatted apart from each other; a block
gets copies of the system turn and of the last turns before it. A block is the most that a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinarm.llm.storage import stage
from twinarm.llm.tokens import default_path, encoder

#: Control strings of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, BLOCK = 1024, 256, 256
SYSTEM, ASSISTANT = "system", "assistant"

_MESSAGE = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def message(role: str, text: str) -> str:
    head = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{OPEN}{head}\n{escape(text)}{CLOSE}\n"


def _role(head: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(head))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the code point span of the escaped text, of each message."""
    out, at = [], 0
    for m in _MESSAGE.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no message at {at}")
        out.append((_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no message at {at}")
    return out


def spans(tokens: list[int], system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """``(history start, start, end)`` of windows over turns, by prefix sums. A window holds one new
    turn at least, even one that is longer than the budget."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, start = [], 0
    while start < len(tokens):
        back = start
        while back and total[start] - total[back - 1] <= history:
            back -= 1
        # New turns come before repeated ones when both do not fit.
        while back < start and system + total[start + 1] - total[back] > budget:
            back += 1
        end = int(np.searchsorted(total, budget - system + total[back], "right")) - 1
        end = max(end, start + 1)
        out.append((back, start, end))
        start = end
    return out


SCHEMA = ("conv_id long, block long, window int, text string, n_repeated int, n_new int, n_tokens long, over_budget boolean, "
          "loss_spans array<struct<start:long,end:long>>")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _windows(rows: list[dict], budget: int, history: int) -> Iterator[dict]:
    """Windows of one block. Carried rows (kind 0 system, 1 history) come before the block's own (2)."""
    system = next((r for r in rows if r["kind"] == 0), None)
    own = [r for r in rows if r["kind"] > 0]
    fresh_system = system is None and own and own[0]["ordinal"] == 0 and own[0]["role"] == SYSTEM
    carried = sum(r["kind"] == 1 for r in own)
    if fresh_system:
        system, own = own[0], own[1:]
    size = [r["n_tokens"] for r in own]
    reserved = system["n_tokens"] if system else 0
    cuts = spans(size[carried:], reserved, budget, history)
    if not cuts:
        cuts = [(0, 0, 0)] if fresh_system else []
    for k, (back, start, end) in enumerate(cuts):
        back, start, end = back + carried, start + carried, end + carried
        if k == 0:  # turns of the block before, as far as the budgets allow
            while back and sum(size[back - 1 : start]) <= history and reserved + sum(size[back - 1 : end]) <= budget:
                back -= 1
        picked = ([system] if system else []) + own[back:end]
        new_system = bool(fresh_system and k == 0)
        repeated = (1 if system and not new_system else 0) + start - back
        new_from = len(picked) - (end - start)
        text, mask = "", []
        for i, r in enumerate(picked):
            whole = message(r["role"], r["text"])
            if i >= new_from and r["role"] == ASSISTANT:
                stop = len(text) + len(whole) - len(CLOSE) - 1
                mask.append({"start": stop - len(escape(r["text"])), "end": stop})
            text += whole
        used = sum(r["n_tokens"] for r in picked)
        yield {"conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "window": k, "text": text, "n_repeated": repeated,
               "n_new": end - start + new_system, "n_tokens": used, "over_budget": used > budget, "loss_spans": mask,
               "new_system": new_system}


def _groups(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, across batches of a sorted partition."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in key):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK,
                 tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations: ``conv_id, block, window, text, n_repeated, n_new, n_tokens,
    over_budget, loss_spans`` (code points).

    A window's first ``n_repeated`` messages repeat earlier ones (those after a new system turn, which
    stands first in the first window, included). Turns are ordered by turn, role and text, null first;
    equal rows are turns of their own. Null roles and texts are empty; a null conversation id is a
    conversation. A turn longer than the budget is kept whole in a window marked ``over_budget``.
    """
    path = tokenizer or default_path()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            size = [len(ids(message(r or "", t or ""))) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.mapInArrow(count, "conv_id long, turn long, role string, text string, n_tokens long")
    turns = stage(turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 60)))))
    # Ordinals by parts of a conversation: counts of whole parts first, rows within a part second.
    before = stage(turns.groupBy("conv_id", "part").agg(F.count("*").alias("c")).select(
        F.col("conv_id").alias("bc"), F.col("part").alias("bp"),
        (F.sum("c").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("c")).alias("before")))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    own = turns.join(before, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("part") == F.col("bp")))
    own = stage(own.withColumn("ordinal", F.col("before") + place - 1)
                .withColumn("block", F.floor(F.col("ordinal") / block))
                .select("conv_id", "block", F.lit(2).alias("kind"), "ordinal", "role", "text", "n_tokens"))
    # What later blocks repeat: the system turn, and the turns that fit the history of the block before.
    later = own.where(f"block > 0 AND ordinal % {block} = 0").select(F.col("conv_id").alias("lc"), F.col("block").alias("to"))
    system = own.where((F.col("ordinal") == 0) & (F.col("role") == SYSTEM)).join(later, F.col("conv_id").eqNullSafe(F.col("lc"))).select(
        "conv_id", F.col("to").alias("block"), F.lit(0).alias("kind"), "ordinal", "role", "text", "n_tokens")
    tail = F.sum("n_tokens").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("ordinal")))
    full = F.count("*").over(Window.partitionBy("conv_id", "block")) == block
    past = (own.withColumn("tail", tail).withColumn("full", full).where((F.col("tail") <= history) & F.col("full"))
            .where(~((F.col("ordinal") == 0) & (F.col("role") == SYSTEM)))
            .select("conv_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), "ordinal", "role", "text", "n_tokens"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), _SPAN)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for rows in _groups(batches, ("conv_id", "block")):
            if all(r["kind"] < 2 for r in rows):  # copies for a block that does not exist
                continue
            held += _windows(rows, budget, history)
            if len(held) >= 1000:
                yield flush()
                held = []
        if held:
            yield flush()

    rows = reduce(DataFrame.unionByName, [own, system, past])
    return (rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "ordinal")
            .mapInArrow(build, SCHEMA))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_windows long, n_over_budget long")


def digests(windows: DataFrame) -> DataFrame:
    """Each conversation read back from its windows; a digest runs over one window after another."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGEST.split(", ")]
        out: list[list] = []
        key, state = None, None

        def close() -> None:
            if state:
                n, turns, chars, loss, total, count, over = state
                out.append([key, n, turns.hexdigest(), chars, loss.hexdigest(), total, count, over])

        def flush() -> pa.RecordBatch:
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != key:
                    close()
                    key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                found = parse(row["text"])
                first = row["block"] == 0 and row["window"] == 0
                # In the very first window a system turn at the front is new; nothing there is repeated.
                new = found if first else found[row["n_repeated"] :]
                for role, text, _, _ in new:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss_spans"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["text"])
                state[5] += 1
                state[6] += row["over_budget"]
            if len(out) >= 1000:
                yield flush()
                out.clear()
        close()
        if out:
            yield flush()

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(read, DIGEST)
