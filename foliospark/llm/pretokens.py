"""Pre-tokens of byte-level BPE and what each distinct one is worth, kept per worker.

BPE merges never cross a pre-token, so a text's ids are those of its pre-tokens end to
end. Each worker asks the tokenizer once for each distinct pre-token it meets and keeps
the answer in a table of at most MOST entries (emptied when full, so memory is bounded).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import regex
from tokenizers import Tokenizer

MOST = 500_000
#: The pattern that byte-level BPE of this kind splits texts by.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Kept(dict):
    """pre-token -> worth; a missing one is looked up by ``fill`` when a text has it."""

    def __init__(self, fill: Callable[[list[str]], list]):
        super().__init__()
        self.fill = fill

    def of(self, tokens: list[str]) -> list:
        """The worth of each token in order."""
        try:
            return list(map(self.__getitem__, tokens))
        except KeyError:
            self.learn(tokens)
            return list(map(self.__getitem__, tokens))

    def learn(self, tokens) -> None:
        new = [t for t in set(tokens) if t not in self]
        if len(self) + len(new) > MOST:
            self.clear()
            new = list(set(tokens))
        self.update(zip(new, self.fill(new), strict=True))


class Pieces:
    """A byte-level BPE tokenizer seen through its pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(SPLIT).findall
        self.counts = Kept(lambda new: [len(e.ids) for e in self.encode(new)])
        self.ids = Kept(lambda new: [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.encode(new)])

    def encode(self, new: list[str]):
        return self.tokenizer.encode_batch(new, add_special_tokens=False) if new else []

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """Stretches of ordinary text, and added tokens that stand in it (True)."""
        if not self.split_added or not any(a in text for a in self.added):
            return [(False, text)]
        return [(i % 2 == 1, x) for i, x in enumerate(self.split_added.split(text)) if x]

    def pretokens(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens of a text in order, and the ids of the added tokens in it."""
        parts = self.parts(text)
        if len(parts) == 1 and not parts[0][0]:
            return self.find(text), []
        out: list[str] = []
        for added, x in parts:
            if not added:
                out += self.find(x)
        return out, [self.added[x] for added, x in parts if added]

    def id_bytes(self, text: str) -> bytes:
        """All ids of a text, four bytes each, little-endian."""
        return b"".join(self.added[x].to_bytes(4, "little") if added else b"".join(self.ids.of(self.find(x))) for added, x in self.parts(text))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per worker and vocabulary file."""
    return Pieces(path)
