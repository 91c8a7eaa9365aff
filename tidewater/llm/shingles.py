"""Sets of hashed word shingles, computed on whole Arrow buffers.

Words are runs of bytes outside [\\x20\\x09-\\x0D], with A-Z lower-cased. A running sum of
byte values times powers of an odd base gives every word's 64-bit hash by one subtraction, so no
Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 4
#: Bytes hashed in one go; a longer text is hashed alone.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ROLL = mixed(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STRETCH + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, texts beginning at `starts`; and the number of words before each text and after the last."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    hashes = mixed((total[e] - total[b]) * inverse[b] + (e - b).astype(np.uint64))
    return hashes, np.searchsorted(b, np.append(starts, len(data)))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text of a string or binary column its sorted set of shingle hashes (uint64).

    A text with fewer words has one shingle, the whole sequence; null or without words: none.
    """
    column = column.cast(pa.large_binary())
    _, offsets, body = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, np.uint8)
    row = 0
    none = np.empty(0, np.uint64)
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + STRETCH, side="right")) - 1)
        stop = min(stop, len(column))
        part = data[offs[row] : offs[stop]]
        if len(part):
            h, at = word_hashes(part, offs[row:stop] - offs[row])
            grams = None
            if len(h) >= words:
                n = len(h) - words + 1
                grams = np.zeros(n, dtype=np.uint64)
                for k in range(words):
                    grams += h[k : k + n] * _ROLL[k]
                grams = mixed(grams)
            for i in range(stop - row):
                lo, hi = at[i], at[i + 1]
                if hi - lo >= words:
                    s = np.sort(grams[lo : hi - words + 1])
                    new = np.empty(len(s), dtype=bool)
                    new[0] = True
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    yield s[new]
                elif hi > lo:
                    yield mixed(np.sum(h[lo:hi] * _ROLL[: hi - lo], keepdims=True) + _ROLL[60 + hi - lo : 61 + hi - lo])
                else:
                    yield none
        else:
            for _ in range(stop - row):
                yield none
        row = stop


def set_id(s: np.ndarray) -> int:
    """A 64-bit number, as a signed integer, that equal sets share."""
    total = int(mixed(s + _U(0x9E6C63D0876A9A47)).sum(dtype=np.uint64)) + len(s) * int(_ROLL[0])
    return int(mixed(np.array([total % (1 << 64)], dtype=np.uint64)).view(np.int64)[0])
