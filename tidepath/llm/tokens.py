"""Vectorised words and hashes of Arrow string columns. Numpy inside tasks; memory is bounded by slices of about a megabyte (or one longer text)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240101))
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(n, 2 * len(_powers)) - 1, _BASE)]))
    return _powers[:n]


@dataclass
class Words:
    """Words of a slice of rows: bytes data[starts[i]:ends[i]]; row r has words first[r] to first[r + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z as a-z if lower."""
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, dtype=np.uint64)
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        codes = self.data[np.repeat(self.starts, lens) + pos]
        vals = (_LOWER if lower else _EXACT)[codes] * _power(int(lens.max()))[pos]
        return mix(np.add.reduceat(vals, at) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def raw_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offs - offs[0]


def split_rows(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, space: np.ndarray = WHITE) -> Words:
    """The words of rows lo to hi, split where `space` is true for a byte."""
    data = data[offsets[lo] : offsets[hi]]
    offs = offsets[lo : hi + 1] - offsets[lo]
    solid = ~space[data]
    inner = offs[(offs > 0) & (offs < len(data))]
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k consecutive values, by place of the first; the last k - 1 values begin none. Rows are not told apart."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    mults = np.random.Generator(np.random.PCG64(7919 + salt)).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * mults[j]
    return mix(out)
