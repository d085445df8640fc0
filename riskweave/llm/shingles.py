"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed on arrays."""

from __future__ import annotations

import numpy as np

SIZE = 5
PIECE_WORDS = 200_000  # words that are hashed at once
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it can be divided by
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
# A-Z in lower case, ASCII white space as a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


class Shingler:
    """``sets(text)``: the distinct shingles of ``SIZE`` words (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``), sorted.
    Fewer words: the whole sequence is one shingle. No words, or null: empty."""

    def __init__(self):
        self._grow(1 << 16)

    def _grow(self, n: int):
        self.power, self.inverse = np.full(n, _BASE), np.full(n, _INVERSE)
        self.power[0] = self.inverse[0] = 1
        self.power, self.inverse = np.cumprod(self.power, dtype=np.uint64), np.cumprod(self.inverse, dtype=np.uint64)

    def sets(self, text: bytes | str | None, size: int = SIZE) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
        folded = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
        blanks = np.flatnonzero(folded == 32)
        if len(blanks) and (blanks[0] == 0 or blanks[-1] == len(folded) - 1 or (np.diff(blanks) == 1).any()):
            folded = np.frombuffer(b" ".join(folded.tobytes().split()), dtype=np.uint8)
            blanks = np.flatnonzero(folded == 32)
        if not len(folded):
            return np.zeros(0, dtype=np.uint64)
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(folded)]])
        if len(starts) <= PIECE_WORDS:
            return _distinct(self._hashes(folded, starts, ends, size))
        parts = []
        for i in range(0, len(starts) - size + 1, PIECE_WORDS - size + 1):
            a, b = starts[i:i + PIECE_WORDS], ends[i:i + PIECE_WORDS]
            parts.append(_distinct(self._hashes(folded[a[0]:b[-1]], a - a[0], b - a[0], size)))
        return _distinct(np.concatenate(parts))

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        if len(raw) > len(self.power):
            self._grow(max(len(raw), 2 * len(self.power)))
        size = min(size, len(starts))
        upto = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.multiply(_BYTE[raw], self.power[:len(raw)], out=upto[1:])
        np.cumsum(upto, out=upto)
        starts, ends = starts[:len(starts) - size + 1], ends[size - 1:]
        h = (upto[ends] - upto[starts]) * self.inverse[starts]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
