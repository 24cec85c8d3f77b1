"""Vectorised word hashing: many texts at a time, a few numpy passes over their bytes.

Words are runs of bytes outside a separator table. A word's hash is
mix(sum of T[byte] * P^position) mod 2^64 with fixed random T and odd P; a run of k
words hashes from its words' hashes the same way. All are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Texts are taken together up to so many bytes, to bound memory.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche (xor-shift multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE, WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


#: The space and \t\n\v\f\r.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All ASCII but letters and digits.
NO_LETTERS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of several texts: hash, place in bytes, and first word of each text (one more at the end)."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: list[bytes], seps: np.ndarray = SPACES, lower: bool = False) -> Words:
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, np.uint8)
    if lower:
        buf = LOWER[buf]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    inside = ~seps[buf]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(buf, starts, ends, np.zeros(0, U), first)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    into = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=into[1:])
    place = np.arange(len(at)) - np.repeat(into, lengths)
    with np.errstate(over="ignore"):
        values = TABLE[buf[at]] * powers(BASE, int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(values, into) + lengths.astype(U))
    return Words(buf, starts, ends, hashes, first)


def runs(hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of each run of k words; n - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        p = powers(base, k)
        total = hashes[:n] * p[0]
        for j in range(1, k):
            total = total + hashes[j : j + n] * p[j]
        return mix(total)


def long_runs(hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """As :func:`runs`, for large k: one pass per power of two."""
    with np.errstate(over="ignore"):
        total, width, done, out = hashes, 1, 0, None
        while True:
            if k & width:
                n = len(hashes) - k + 1
                if n <= 0:
                    return np.zeros(0, U)
                part = total[done : done + n] * U(pow(base, done, 1 << 64))
                out = part if out is None else out + part
                done += width
            if done == k:
                return mix(out)
            total = total[: max(len(total) - width, 0)] + total[width:] * U(pow(base, width, 1 << 64))
            width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def chunks(ids: list, texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in groups of about ``most`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield ids[at:i], texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield ids[at:], texts[at:]
