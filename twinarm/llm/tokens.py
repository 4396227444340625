"""Token ids of many texts with a given tokenizer file."""

from __future__ import annotations

import array
import json
import os
import re
import sys
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the public splitting pattern of the byte-level vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longest run of white space that the pattern may meet in ``tiktoken``, whose matcher keeps one place to
#: go back to for each of its characters and gives up at a million.
SPACES = 100_000
_SPACES = re.compile(r"\s+")


def long_spaces(text: str) -> bool:
    return len(text) > SPACES and any(m.end() - m.start() > SPACES for m in _SPACES.finditer(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary spells as characters: printable ones as themselves, the
    others, in order, as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    A byte-level file whose ids follow its merges is read into ``tiktoken``, which gives the same ids
    three times as fast; any other file, and a text with the string of an added token or a very long run
    of white space in it, goes through ``tokenizers`` itself, by the file's own defaults.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                 and before.get("use_regex", True) and not spec.get("normalizer"))
        if not plain:
            return None
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        ordered = [vocabulary.get(m.replace(" ", "")) for m in merged]
        if ordered != sorted(set(ordered)) or ordered and ordered[0] != 256:
            return None
        import tiktoken

        of, special = _byte_of(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not (self.added and self.added.search(text)) and not long_spaces(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        found = array.array("I", self.ids(text))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    @cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id; a byte-level vocabulary spells every byte as one character, but added tokens
        stand as they are."""
        out = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
