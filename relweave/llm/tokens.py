"""Byte-level BPE ids of whole texts, as little-endian bytes.

Texts are merged by ranks as a whole wherever the vocabulary is a table of ranks. Other vocabularies go
through a bounded cache of pieces: a single space between two characters that are not white space always
begins a pre-token of the usual pattern, whatever stands before it, so texts are cut there, and the ids of
each different piece are computed once per worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Pieces a worker remembers before it starts anew.
CACHE_PIECES = 120_000

_NO_SPECIAL: frozenset[str] = frozenset()
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Irregular(Exception):
    """A piece next to which a single space is no safe cut."""


class _Cache(dict):
    """Ids of pieces as bytes, computed when first asked for."""

    def __init__(self, ids_of, code: str, lead: str):
        super().__init__()
        self.ids_of, self.code, self.lead = ids_of, code, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace() or (self.lead and piece[0].isspace()):
            raise _Irregular
        made = self[piece] = array(self.code, self.ids_of(self.lead + piece)).tobytes()
        return made


class PieceCoder:
    """Encodes texts with ``ids_of``, a function from a string to its ids."""

    def __init__(self, ids_of, code: str):
        self.ids_of, self.code = ids_of, code
        self.spaced, self.first = _Cache(ids_of, code, " "), _Cache(ids_of, code, "")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        for cache in (self.spaced, self.first):
            if len(cache) > CACHE_PIECES:
                cache.clear()
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))
        except _Irregular:
            parts = _CUT.split(text)
            pieces = [parts[0], *(" " + p for p in parts[1:])]
            return array(self.code, chain.from_iterable(map(self.ids_of, pieces))).tobytes()


class RankCoder:
    """Encodes texts by ranks. It keeps no pieces: natural text has too many different words to remember."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, code: str):
        import tiktoken

        # one special string, never allowed, so never made: without any, every place of a text would be tried
        special = {"<|none|>": max(ranks.values(), default=-1) + 1}
        self.merger = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.code = code

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        try:  # 32-bit ids as they are, not a list of numbers
            ids = self.merger.encode_to_numpy(text, allowed_special=_NO_SPECIAL, disallowed_special=())
        except UnicodeEncodeError:  # half a surrogate pair
            ids = np.array(self.merger.encode_ordinary(text), np.uint32)
        return ids.astype("<u2" if self.code == "H" else "<u4", copy=False).tobytes()


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_coder(path: str, pattern: str) -> RankCoder:
    """32-bit ids by ranks; each match of the pattern is merged on its own."""
    return RankCoder(read_ranks(path), pattern, "I")


@lru_cache(maxsize=4)
def rank_table(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


@lru_cache(maxsize=4)
def file_coder(path: str, pattern: str | None = None) -> RankCoder | PieceCoder:
    """Ids of a tokenizers file without special tokens; 16 bits wide where the vocabulary allows it.

    Where ``pattern`` is given and the file is a plain byte-level BPE whose merges make ids in rising
    order, its vocabulary says the same as a table of ranks, and the faster merging by ranks gives the
    same ids. The tokenizers library, which takes as much memory again, is loaded for other files only.
    """
    import os

    if pattern and (found := _ranks_of(path)):
        ranks, size = found
        return RankCoder(ranks, pattern, id_code(size))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True  # their strings in a text are ordinary text
    code = id_code(coder.get_vocab_size(with_added_tokens=True))
    return PieceCoder(lambda piece: coder.encode(piece, add_special_tokens=False).ids, code)


def _ranks_of(path: str) -> tuple[dict[bytes, int], int] | None:
    """The vocabulary of a tokenizers file as ranks, and its size with the added tokens, if it is
    byte-level BPE with ids in merge order."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(p)] for p in pairs]
    if made != sorted(made) or len(set(made)) < len(made):
        return None
    # byte-level files write a byte as itself where it is printable, and the others from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return (ranks, len(special | model["vocab"].keys())) if all(bytes([b]) in ranks for b in range(256)) else None


def id_code(size: int) -> str:
    return "H" if size <= 65_536 else "I"


def as_ids(raw: bytes, code: str) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if code == "H" else "<u4")
