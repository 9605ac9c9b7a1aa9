"""Sorted 64-bit hashes and small counts as compact bytes, for shuffles of packed rows.

A batch of documents sends one row per hash range instead of one row per word: the rows
that Spark moves are few, and the bytes are what the numbers need.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard


class WordHashes(dict):
    """XXH64 of words, kept for words that come again; the memory it may take is bounded."""

    LIMIT = 200_000

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length as bytes; the first is sorted and kept as differences.

    Every column is cut to the bytes its largest value needs and stored byte plane by byte
    plane, so that constant planes vanish in compression.
    """
    n = len(columns[0])
    out = [np.array([n, len(columns), columns[0][0] if n else 0], "<u8").tobytes()]
    for i, c in enumerate(columns):
        c = c.astype("<u8")
        if i == 0 and n:
            c = np.concatenate((np.zeros(1, "<u8"), np.diff(c)))
        width = max(1, -(-int(c.max()).bit_length() // 8)) if n else 1
        out += [bytes([width]), np.ascontiguousarray(c.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of ``pack``, as unsigned 64-bit words."""
    raw = zstandard.decompress(data)
    n, k, first = np.frombuffer(raw, "<u8", 3)
    n, at, columns = int(n), 24, []
    for i in range(int(k)):
        width = raw[at]
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        c = c.view("<u8").reshape(n)
        columns.append(np.cumsum(c, dtype=np.uint64) + first if i == 0 else c)
        at += 1 + n * width
    return columns
