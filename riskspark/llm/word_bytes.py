"""Words of many texts at a time as numpy arrays over one block of bytes.

A block is the texts behind each other in UTF-8, one separator before each and one behind the last. Separators
are single bytes below 128, so no sign of several bytes is ever cut.
"""

from __future__ import annotations

import numpy as np

SPACE = 32
# A-Z lower-cased and every other ASCII sign but letters and digits made a blank.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else SPACE for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def block(texts: list[str], table: bytes = ALNUM_TABLE, between: bytes = b" ") -> tuple[bytes, np.ndarray]:
    """The translated bytes and where each text begins; one more place stands behind the last."""
    raw = [t.encode() for t in texts]
    places = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return (between + between.join(raw) + between).translate(table), places


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind its last, of a block whose only separator is the blank."""
    blank = np.frombuffer(data, np.uint8) == SPACE
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    made = np.full(n + 1, base, np.uint64)
    made[0] = 1
    return np.multiply.accumulate(made)


class WordHashes:
    """64-bit hashes of words: their bytes as digits of an odd base modulo 2^64, mixed at the end."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_UNBASE, len(data))
        digits = np.frombuffer(data, np.uint8).astype(np.uint64)
        digits += np.uint64(1)
        digits *= self.up[:len(digits)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digits, dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)
