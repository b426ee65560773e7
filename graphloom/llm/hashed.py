"""Hashed n-gram features of many texts at once, as numpy arrays.

Texts are laid one after another with zero bytes between them, so that no n-gram holds bytes of two texts.  A
feature is an index below ``1 << bits``.  Results do not depend on which texts share a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAD = 8
_RATIO = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RATIO, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << n.bit_length()
        for k, base in enumerate((_RATIO, _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, k
            first, total = k, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


class Texts:
    """Texts side by side: ``start`` and ``end`` are each text's bytes in ``raw``."""

    def __init__(self, texts: list[bytes], lower: bool):
        pad = b"\0" * PAD
        raw = np.frombuffer(pad.join(texts) + pad, np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + sizes
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._chars: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def grams(self, n: int, bits: int) -> np.ndarray:
        """A feature for each byte place: the n bytes from there (n at most 8)."""
        kind = np.uint32 if n <= 4 else np.uint64
        m = len(self.raw) - PAD
        x = self.raw[:m].astype(kind)
        for k in range(1, n):
            x |= self.raw[k : m + k].astype(kind) << kind(8 * k)
        if kind is np.uint32:
            x *= np.uint32(0x9E3779B1 + 2 * n)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            return (x >> np.uint32(32 - bits)).astype(np.int32)
        x *= np.uint64(_RATIO + 2 * n)
        return (x >> np.uint64(64 - bits)).astype(np.int32)

    def char_grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A feature for each character place (code point): the n characters from there; and each text's places."""
        if self._chars is None:
            points = [np.frombuffer(self.raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4") for a, b in zip(self.start.tolist(), self.end.tolist())]
            sizes = np.fromiter(map(len, points), np.int64, len(points))
            pad = np.zeros(PAD, np.uint32)
            flat = np.concatenate([x for p in points for x in (p, pad)] or [pad])
            first = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]]).astype(np.int64) if len(points) else np.zeros(0, np.int64)
            self._chars = flat.astype(np.uint64), first, first + sizes
        flat, first, last = self._chars
        m = len(flat) - PAD
        x = np.full(m, n, np.uint64)
        for k in range(n):
            x = x * np.uint64(_RATIO) + flat[k : m + k]
        x ^= x >> np.uint64(29)
        x *= _MIX[0]
        return (x >> np.uint64(64 - bits)).astype(np.int32), first, last

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and 64-bit hashes of the words (runs without white space)."""
        if self._words is None:
            space = _SPACE[self.raw]
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            if not space[0]:
                edge = np.concatenate([[0], edge])
            s, e = edge[::2], edge[1::2]
            power, inverse = _power(len(self.raw))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[: len(self.raw)])])
            self._words = s, e, mix((total[e] - total[s]) * inverse[s])
        return self._words

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, where its items begin and end in a sorted array of byte places."""
        return np.searchsorted(places, self.start), np.searchsorted(places, self.end)


def fold(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def pairs(h: np.ndarray, s: np.ndarray, t: Texts) -> np.ndarray:
    """Hash of each word with the next; the last word of a text stands with nothing."""
    nxt = np.zeros(len(h), np.uint64)
    if len(h):
        nxt[:-1] = h[1:]
        _, last = t.spans(s)
        nxt[last[last > 0] - 1] = 0
    return mix(h * np.uint64(3) + nxt * np.uint64(0xD6E8FEB86659FD93))


def sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of ``values[a:b]`` for each text; 0 where empty."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[b] - total[a]
