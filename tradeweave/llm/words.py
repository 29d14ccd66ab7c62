"""ASCII-blank separated words, lower-cased in A-Z only, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a Python worker remembers.
KNOWN_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()


def split(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII letters and blanks only."""
    return text.encode().lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))
