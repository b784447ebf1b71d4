"""Hashes of words and word n-grams straight from Arrow's UTF-8 buffers, vectorised over a batch."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  #: bytes of text hashed at a time
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: freed memory stays with the worker
    _libc = None

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """Byte -> byte + 1, lower-cased A-Z, and 0 for separators."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


#: \x20 and \t..\r separate; A-Z are lower-cased.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: All ASCII characters but letters and digits separate.
PLAIN = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the end)."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    b = table[data]
    start = b != 0
    follows = start[:-1].copy()
    start[1:] &= ~follows
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = b[inner] != 0  # a word never crosses texts
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    ends = np.append(starts[1:], len(data))
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # whole words, about a megabyte at a time: the working arrays take many bytes for each byte of text
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        seg, at = b[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        place = np.arange(len(seg)) - np.repeat(at, np.diff(np.append(at, len(seg))))
        out[i:j] = np.add.reduceat(seg.astype(np.uint64) * _powers(1 << int(place.max()).bit_length())[place], at)
        i = j
    return mix(out), np.searchsorted(starts, offsets)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.cumprod(np.full(n - 1, 0x9DDFEA08EB382D69, dtype=np.uint64), out=out[1:])
    return out


def trim() -> None:
    """Give freed memory back to the system: an executor's workers stay alive, each with what its largest step has held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    k = odd(seed, n)
    out = h[: len(h) - n + 1] * k[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * k[j]
    return mix(out)
