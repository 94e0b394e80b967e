"""Vectorised word tables and rolling hashes over Arrow text columns.

A chunk of rows is one byte array; words, their hashes and the hashes of word
windows are computed with whole-array numpy operations, so that no Python code
runs per word.  Hashes are polynomials modulo 2**64 over mixed symbols, so a
window's hash follows from prefix sums (Karp-Rabin) in constant time.

Such polynomials have strings of 1,024 symbols that collide whatever the base
(Thue-Morse).  Words of over 256 bytes are therefore hashed by BLAKE2b, and
windows of words must be shorter than ``SPAN_WORDS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Bytes of the longest word that has a polynomial hash, words of a window.
LONG_WORD, SPAN_WORDS = 256, 512

_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASE = 0xD1B54A32D192ED03


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Values of the bytes under the two independent hashes.
_BYTE_VALUES = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(base)) for k, base in enumerate(_BYTE_BASES)]


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Words are runs of bytes other than 0x20 and 0x09-0x0D.
BLANK_SEPARATED = ~_class(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of non-ASCII bytes.
ALPHANUMERIC = _class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256)))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self._bases = (base, pow(base, -1, 1 << 64))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            size = max(n, 2 * len(self._tables[0]))
            for k, base in enumerate(self._bases):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                self._tables[k] = np.cumprod(table)
        return self._tables[0], self._tables[1]


_byte_powers, _word_powers = [_Powers(base) for base in _BYTE_BASES], _Powers(_WORD_BASE)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


class WordTable:
    """Words of a chunk: byte bounds, row and hash of each, in text order."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray):
        n = len(data)
        inside = word_bytes[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        edges = offs[:-1]
        before[edges] = False  # a word ends with its text
        after[edges] = False
        self.starts = np.flatnonzero(inside & ~before[:n])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.rows = np.searchsorted(offs, self.starts, "right") - 1
        self._data = data
        self.hashes = self._word_hashes(0)
        #: first word of each row, and the number of words at the end
        self.bounds = np.searchsorted(self.rows, np.arange(len(offs)))
        self._sums: dict[int, np.ndarray] = {}

    def _word_hashes(self, which: int) -> np.ndarray:
        """The words' hashes of 64 bits; the two kinds are independent."""
        data, n = self._data, len(self._data)
        power, inverse = _byte_powers[which](n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[which][data] * power[:n], out=sums[1:])
        hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[self.starts[k] : self.ends[k]].tobytes(), digest_size=16).digest()
            hashes[k] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        return hashes

    def __len__(self) -> int:
        return len(self.starts)

    def span_hashes(self, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the word sequences first <= i < end, of under SPAN_WORDS
        words; ``which`` tells the two independent hashes apart."""
        power, inverse = _word_powers(len(self) + 1)
        if which not in self._sums:
            values = self._word_hashes(which) if which else self.hashes
            sums = self._sums[which] = np.zeros(len(self) + 1, np.uint64)
            np.cumsum(values * power[: len(self)], out=sums[1:])
        sums = self._sums[which]
        return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))

    def window_starts(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words inside one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.rows[:n] == self.rows[size - 1 :])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of ``width`` values."""
    least, where, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left = least[:-step] <= least[step:]
        least, where = np.where(left, least[:-step], least[step:]), np.where(left, where[:-step], where[step:])
        span += step
    return where
