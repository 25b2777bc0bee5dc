"""Words and word hashes of a column of texts, many texts at a time.

A word is a run of bytes that are digits, ASCII letters (lower-cased) or at least 0x80; hashes are polynomial over the
bytes, modulo 2^64, taken as differences of one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (_BYTE >= 0x80)
#: bytes.translate() with this leaves words and spaces.
AS_WORDS = bytes(int(LOWER[b]) if IS_WORD[b] else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
SLICE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = _powers[name] = np.multiply.accumulate(x)
    return have


@dataclass
class Words:
    """hashes: one for each word; first[i] : first[i + 1] are those of text i; lo + i is its row."""

    lo: int
    first: np.ndarray
    hashes: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and ends; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(texts: pa.Array) -> Iterator[Words]:
    data, at = buffers(texts)
    for lo, hi in slices(at):
        b = data[at[lo] : at[hi]]
        off = at[lo : hi + 1] - at[lo]
        n = len(b)
        if not n:
            yield Words(lo, np.zeros(hi - lo + 1, np.int64), np.zeros(0, np.uint64))
            continue
        inside = IS_WORD[b]
        edge = off[(off > 0) & (off < n)]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[edge] |= inside[edge]
        end[:-1] &= ~inside[1:]
        end[edge - 1] |= inside[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((LOWER[b].astype(np.uint64) + np.uint64(1)) * _power("p", _P, n)[:n], out=run[1:])
        yield Words(lo, np.searchsorted(starts, off), mix64((run[ends] - run[starts]) * _power("inv", _P_INV, n)[starts]))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and the text (from 0) that it is in; a text with fewer words, but not none, has one run of all."""
    n = np.diff(w.first)
    if len(w.hashes) >= size:
        h = np.zeros(len(w.hashes) - size + 1, np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w.hashes[j : len(h) + j]
        owner = np.repeat(np.arange(len(n)), n)
        same = owner[: len(h)] == owner[size - 1 :]
        h, owner = h[same], owner[: len(h)][same]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        more = []
        for i in short:
            x = np.uint64(int(n[i]))
            for y in w.hashes[w.first[i] : w.first[i + 1]]:
                with np.errstate(over="ignore"):
                    x = x * np.uint64(0xA0761D6478BD642F) + y
            more.append(x)
        h, owner = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([owner, short])
    return mix64(h), owner
