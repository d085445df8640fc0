"""Hashed character n-grams of whole texts, computed on arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PIECE_CHARS = 1 << 20  # code points of a text that are held as arrays at once


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_ids(points: np.ndarray, orders: Sequence[int], bits: int) -> np.ndarray:
    """Bucket (0 .. 2**bits - 1) of every n-gram of every order, in text order."""
    out = []
    for k in orders:
        n = len(points) - k + 1
        if n <= 0:
            continue
        h = np.full(n, (k * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(k):
            h = (h ^ points[j:j + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def pieces(text: str, overlap: int) -> Iterator[np.ndarray]:
    """The text's code points in bounded pieces; each repeats the last ``overlap`` of the one before,
    so that the n-grams of order ``overlap + 1`` of all pieces are exactly those of the text (a lower
    order sees the few n-grams inside the overlap twice)."""
    for start in range(0, max(len(text), 1), PIECE_CHARS):
        yield code_points(text[max(0, start - overlap):start + PIECE_CHARS])
