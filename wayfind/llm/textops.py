"""Word and word-sequence hashing over Arrow text buffers, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are read as
UTF-8 buffers in slices of half a MB, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 64)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


@dataclass
class Words:
    """Byte ranges of the words of several texts, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # per text: index of its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    gap = np.empty(len(buf) + 1, dtype=bool)
    np.take(space, buf, out=gap[:-1])
    gap[-1] = True
    inside = ~gap[:-1]
    before = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = True
        before[1:] = gap[:-2] if len(buf) > 1 else gap[:0]
        before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    start = np.flatnonzero(inside & before)
    after = gap[1:].copy()
    inner = offsets[1:]
    after[inner[(inner > 0)] - 1] = True
    end = np.flatnonzero(inside & after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def word_hashes(buf: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    codes = np.take(_BYTE_CODE, buf)
    codes *= _power(int(_MULT), len(buf))[: len(buf)]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(codes, out=total[1:])
    out = total[words.end] - total[words.start]
    out *= _power(int(_INV), len(buf))[words.start]
    return mix(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries, across text borders too."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(int(_MULT), len(hashes))[: len(hashes)], out=total[1:])
    out = total[k:] - total[:-k]
    out *= _power(int(_INV), len(hashes))[: len(out)]
    return mix(out + _U(k))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) of at least one text each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
