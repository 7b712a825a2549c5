"""Vectorised word scanning of Arrow text columns.

Texts are read as one flat byte buffer per chunk of rows, so finding and hashing
words costs a few numpy passes over the bytes instead of Python work per word.
Only ASCII bytes separate words in every rule used here, and no byte of a UTF-8
multi-byte character is ASCII, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Rows are cut into chunks of about this many bytes; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE, _BASE_INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def byte_codes(lower: bool) -> np.ndarray:
    """The hash code of each byte; with lower, A-Z share the codes of a-z."""
    codes = _BYTE_CODE.copy()
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def separators(white_space_only: bool) -> np.ndarray:
    """Which bytes end a word: white space, or every ASCII byte that is no letter or digit."""
    table = np.zeros(256, dtype=bool)
    if white_space_only:
        table[[9, 10, 11, 12, 13, 32]] = True
    else:
        table[:128] = True
        for low, high in ((48, 58), (65, 91), (97, 123)):
            table[low:high] = False
    return table


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        _powers[:] = []
        for base in (_BASE, _BASE_INV):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of a chunk: hashes, the byte ranges [start, end), and first[i]..first[i+1] as text i's words."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and its len + 1 offsets, starting from 0."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, at = flat_text(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def scan_words(data: np.ndarray, at: np.ndarray, codes: np.ndarray, seps: np.ndarray) -> Words:
    """Find and hash every word of the texts laid out in data at the offsets `at`."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U64), none, none, np.zeros(len(at), dtype=np.int64))
    inside = ~seps[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | cut[1:])) + 1
    base, inverse = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(codes[data] * base[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    return Words(hashes, start, end, np.searchsorted(start, at))


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words that lies in one text, and the index of its first word."""
    h = words.hashes
    if len(h) < width:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    n = len(h) - width + 1
    out = np.zeros(n, dtype=U64)
    for k in range(width):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[k : k + n]
    doc_end = np.repeat(words.first[1:], np.diff(words.first))[:n]
    keep = np.flatnonzero(np.arange(n) + width <= doc_end)
    return mix(out[keep] + U64(width)), keep
