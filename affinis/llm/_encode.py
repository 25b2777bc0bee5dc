"""Byte-pair identifiers of texts as 16-bit numbers, by the library for the vocabulary file."""

from __future__ import annotations

import base64
import sys

import numpy as np

RANKS = "byte_bpe_50k.tiktoken"
END = 50256


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if sys.byteorder != "little":
            raise OSError("identifiers are written as they stand in memory, which must be little-endian")
        if max(ranks.values()) >= END:
            raise ValueError("identifiers must leave room for the end mark in 16 bits")
        self.library = tiktoken.Encoding("affinis", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One for each worker and file; it remembers no texts."""
    if path is None or path not in _LOADED:
        import public_tokenizers

        path = path or public_tokenizers.path(RANKS)
        if path not in _LOADED:
            _LOADED[path] = Encoder(path, public_tokenizers.PATTERN)
    return _LOADED[path]
