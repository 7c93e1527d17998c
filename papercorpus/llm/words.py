"""Words, lines and rolling hashes of many texts at once, in numpy.

Texts are UTF-8 bytes laid end to end with a line break between them. Words are runs of
bytes other than ``\\x20`` and ``\\x09-\\x0D``; no byte of a longer UTF-8 character is one
of these, so bytes and characters agree on where words are. Hashes are polynomials
modulo 2^64, finished by a bijective mix: equal texts have equal hashes, and different
ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15
_powers = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


class Texts:
    """A run of texts with the bounds of their words."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.bound = np.concatenate([[0], np.cumsum(sizes)])  # text i is [bound[i], bound[i + 1] - 1)
        inside = ~SPACE[self.buf]
        edge = np.diff(inside.view(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.bound)  # words of text i: first[i]:first[i + 1]
        self._sum = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Running count of flagged bytes, one longer than the bytes."""
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    def code_points(self) -> np.ndarray:
        return self.count((self.buf & 0xC0) != 0x80)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of each span [a, b) of bytes."""
        up, down = powers(len(self.buf))
        if self._sum is None:
            self._sum = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[self.buf] * up, dtype=U64)])
        return mix64((self._sum[b] - self._sum[a]) * down[a] + (b - a).astype(U64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, and the first line of each text (and one more)."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        return starts, ends, np.searchsorted(starts, self.bound)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the last n - 1 have none."""
    size = max(0, len(words) - n + 1)
    total = words[:size].copy()
    for k in range(1, n):
        total = total * U64(BASE) + words[k : k + size]
    return mix64(total)


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each item, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def runs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of the texts with about ``limit`` bytes, so that arrays stay small."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
