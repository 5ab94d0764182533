"""Words of UTF-8 texts as numpy arrays: where each begins and ends, its text, and a 64-bit hash.

A word is a run of bytes other than space and 0x09 to 0x0D. Texts come as one Arrow array; a null text counts as
empty. Work goes over slices of about SLICE bytes, so memory doesn't follow a batch's size (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


#: The second modulus, a prime: sums of powers modulo 2**64 alone are equal for some regular texts (Thue-Morse words).
PRIME = U((1 << 31) - 1)
_ROOT = 48271
_SMALL = (_BYTE >> U(33)) % PRIME


def _fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x modulo PRIME, under 2**32 for x under 2**62."""
    return (x & PRIME) + (x >> U(31))


@lru_cache(maxsize=2)
def _prime_powers(size: int) -> np.ndarray:
    out = np.ones(1, U)
    while len(out) < size:
        out = np.concatenate([out, out * U(pow(_ROOT, len(out), int(PRIME))) % PRIME])
    return out


def prime_powers(n: int) -> np.ndarray:
    return _prime_powers(1 << max(16, int(n).bit_length()))[:n]


@lru_cache(maxsize=4)
def _powers(size: int, inverse: bool) -> np.ndarray:
    out = np.full(size, _BASE_INV if inverse else _BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or its inverse) modulo 2**64."""
    return _powers(max(1 << 16, 1 << int(n).bit_length()), inverse)[:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Sums s so that (s[b] - s[a]) times the base's power -a is a hash of bytes a to b."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * powers(len(data)), out=total[1:])
    return total


class Sums:
    """Hashes of any stretch of a sequence, from running sums modulo 2**64; those of over long take a sum modulo PRIME too."""

    def __init__(self, values: np.ndarray, small: Callable[[np.ndarray], np.ndarray], long: int) -> None:
        self.total, self._small, self.long = np.zeros(len(values) + 1, U), small, long
        np.cumsum(values * powers(len(values)), out=self.total[1:])

    @staticmethod
    def of_bytes(data: np.ndarray) -> Sums:
        return Sums(_BYTE[data], lambda at: _SMALL[data[at]], 32)

    @staticmethod
    def of_words(hashes: np.ndarray) -> Sums:
        return Sums(hashes, lambda at: hashes[at] % PRIME, 128)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.total[end] - self.total[start]) * powers(len(self.total), True)[start])
        long = np.flatnonzero(end - start > self.long)
        for some in np.array_split(long, max(1, int((end[long] - start[long]).sum()) >> 22)) if len(long) else ():
            size = (end - start)[some]
            last = np.cumsum(size)
            place = np.arange(int(last[-1])) - np.repeat(last - size, size)
            sums = np.add.reduceat(_fold(self._small(np.repeat(start[some], size) + place) * prime_powers(int(size.max()))[place]), last - size)
            out[some] = mix(out[some] + mix(sums % PRIME))
        return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about size bytes together, and one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


@dataclass
class Words:
    """Of texts: data and offsets as text_bytes() has them; of each word: start, end, row and hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """For each text, the index of its first word; one entry more at the end."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)), "left")


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True, space: np.ndarray = SPACE) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    solid = ~space[data]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
        before &= ~head[:-1]
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
        after &= ~head[1:]
    end = np.flatnonzero(solid & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    hashes = np.zeros(0, U)
    if hashed and len(start):
        hashes = Sums.of_bytes(data).hash(start, end)
    return Words(data, offsets, start, end, row, hashes)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (a few dozen at most), from their hashes; text borders aren't heeded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(n, True))


def batches(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, row past the last, their words) over slices of the texts."""
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        yield a, b, find_words(data[part[0] : part[-1]], part - part[0], lower, hashed)
