"""Words of a text as 64-bit ids, and the distinct shingles built on them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Ids remembered per task; the memory is dropped and begun anew beyond that.
REMEMBERED = 300_000

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64
)


class WordIds(dict):
    """64-bit ids of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; a shorter text is one shingle."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = mixed(total * _MULTIPLIERS[i % 5] + words[i : len(words) - width + 1 + i])
    return np.unique(total)
