"""Reading a byte-level BPE vocabulary file (its path is always a parameter)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte) if byte in plain else chr(free))
        free += byte not in plain
    return letters


@dataclass(frozen=True)
class Vocabulary:
    """Tokens and merges of one file; ``suffix`` marks the end of a word, if the vocabulary has such a mark."""

    tokens: list[str]
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str

    @property
    def special_pattern(self) -> re.Pattern | None:
        names = sorted(self.special, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    @property
    def special_sign(self) -> str:
        """A character that all special strings have, a sign rather than a letter; else the empty string, which all texts have."""
        common = set.intersection(*map(set, self.special)) if self.special else set()
        return min(common, key=lambda c: (c.isalnum() or c.isspace(), c), default="")

    def byte_ids(self, last: bool = False) -> np.ndarray:
        """Id of each single byte, or of each byte at the end of a word."""
        return np.array([self.ids[c + self.suffix * last] for c in byte_letters()], np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a vocabulary once per process."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model = content["model"]
    for added in content["added_tokens"]:
        if added["single_word"] or added["lstrip"] or added["rstrip"] or added["normalized"]:
            raise ValueError(f"added token {added['content']!r} uses an option that is not supported")
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        raise ValueError("a byte-level BPE vocabulary is needed")
    special = {a["content"]: a["id"] for a in content["added_tokens"]}
    ids = model["vocab"] | special
    tokens = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return Vocabulary(tokens, model["vocab"], merges, special, model.get("end_of_word_suffix") or "")
