"""Vectorised text primitives on Arrow columns: words, hashes of spans, sliding minima.

Words are maximal runs of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo 2**64
over a fixed random table of byte values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_SPACES = np.array([0x20, *range(0x09, 0x0E)])
_SOLID = np.ones(256, bool)
_SOLID[_SPACES] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1


class _Powers:
    """base**i modulo 2**64 for i >= 0 and, by the inverse, for i <= 0; grows on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size or not self.size:
            self.size = max(n, 1 << 16, self.size * 2 if self.size < 1 << 22 else n)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.size, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = {base: _Powers(base) for base in (_BASE, _GRAM)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """S with S[i] = sum of values[j] * base**j over j < i."""
    up, _ = _POWERS[base].upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal contents wherever they stand."""
    _, down = _POWERS[base].upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def solid(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return _SOLID[data]


class Texts:
    """Bytes of consecutive texts: data, and bounds with text i in data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int = 0) -> None:
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> "Texts":
        """A-Z in lower case, all else unchanged."""
        return Texts(_LOWER[self.data], self.bounds, self.first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each text the number of its first word (one more number at the end)."""
        return self.runs(_SOLID)

    def runs(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the maximal runs of bytes that members, a flag for each byte value, has."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.bounds), np.int64)
        solid = members[self.data]
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        begin[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def word_hashes(self, members: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, firsts = self.runs(members)
        return span_hashes(prefix_sums(_BYTE[self.data]), starts, ends), starts, ends, firsts

    def byte_grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each place (places in the last k - 1 get none)."""
        sums = prefix_sums(_BYTE[self.data])
        at = np.arange(max(0, len(self.data) - k + 1))
        return span_hashes(sums, at, at + k)

    def pieces(self, limit: int = CHUNK_BYTES) -> Iterator["Texts"]:
        """The texts in pieces of about limit bytes, never cutting a text."""
        at = 0
        while at < len(self):
            to = min(max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + limit, side="right")) - 1), len(self))
            yield Texts(self.data[self.bounds[at] : self.bounds[to]], self.bounds[at : to + 1] - self.bounds[at], at)
            at = to

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place on."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return span_hashes(prefix_sums(hashes, _GRAM), at, at + k, _GRAM)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column in pieces of about limit bytes, never cutting a text; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over values[i:i + width] for each i that has so many."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for the next."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def sort_within(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sorts values[bounds[i]:bounds[i + 1]] in place, for each i."""
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()


def distinct_in_order(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each span in ascending order, and the spans' new bounds."""
    sort_within(values, bounds)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]
