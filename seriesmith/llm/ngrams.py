"""Hashed character n-grams of many texts at once, in numpy.

Texts are folded to lower-case letters and single code points for everything
else (a blank), laid end to end with blanks around each, and every position's
n-gram is hashed by a rolling polynomial. What is computed per text is a sum
over its positions, so very long texts are taken in slices.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np

#: Code points of text laid out at a time.
SLICE = 1 << 20

_MIX, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _fold_table() -> np.ndarray:
    """Code point (of the basic plane) -> its lower-case letter, or a blank."""
    kept = sys.__dict__.setdefault("_seriesmith_fold", {})
    if "table" not in kept:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        kept["table"] = table
    return kept["table"]


def laid_out(texts: Sequence[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(folded code points, starts, indexes of the texts) of slices of the texts.

    A text's part is preceded by a blank and followed by one; a longer text is
    cut into parts that share ``overlap`` code points, so that no n-gram of
    overlap + 1 code points is lost or counted twice.
    """
    table = _fold_table()

    def made(parts: list[str], index: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        folded = table[np.minimum(codes, 0xFFFF)]
        folded = np.where(codes > 0xFFFF, codes, folded).astype(np.uint32)
        starts = np.zeros(len(parts), np.int64)
        np.cumsum([len(p) for p in parts[:-1]], out=starts[1:])
        return folded, starts, np.array(index)

    parts: list[str] = []
    index: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        whole = f" {text or ''} "
        step = SLICE - overlap
        for at in range(0, max(1, len(whole) - overlap), step):
            part = whole[at : at + SLICE]
            parts.append(part)
            index.append(i)
            size += len(part)
            if size >= SLICE:
                yield made(parts, index)
                parts, index, size = [], [], 0
    if parts:
        yield made(parts, index)


def hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (of 2**bits) of the n-gram that begins at each position."""
    h = codes * _MIX
    rolled = h[: len(codes) - n + 1].copy() if n > 1 else h
    for k in range(1, n):
        rolled *= _SPREAD
        rolled += h[k : len(codes) - n + 1 + k]
    rolled ^= rolled >> np.uint32(15)
    rolled *= _MIX
    return rolled >> np.uint32(32 - bits)


def bounded(starts: np.ndarray, total: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 position at which each part has a whole n-gram."""
    ends = np.append(starts[1:], total) - (n - 1)
    return starts, np.maximum(ends, starts)


def position_sums(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range of positions."""
    running = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=running[1:])
    top = len(values)
    return running[np.minimum(stop, top)] - running[np.minimum(first, top)]
