"""Lookups over whole Arrow buffers: the pieces of a text column, exact tables of byte strings and of small keys.

Pieces are found, looked up and added up with numpy, so a word costs no Python object, known or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tidewater.llm.shingles import mixed

#: Bytes of text that are looked up in one go; a longer text alone.
STRETCH = 1 << 20
#: Bytes of a piece that a table's arrays hold; longer ones stand in a dict.
WIDTH = 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_U = np.uint64
_CUT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def stretches(column: pa.Array, stretch: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string or binary column in parts of about `stretch` bytes: (first row, bytes, begin of each row and the end).

    A longer text comes in several parts of its own, cut at white space, each with its row.
    """
    column = column.cast(pa.large_binary())
    _, offsets, body = column.buffers()
    if not len(column):
        return
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offs, offs[row] + stretch, side="right")) - 1
        if stop > row:
            yield row, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
            row = stop
            continue
        at, end = int(offs[row]), int(offs[row + 1])
        while at < end:
            to = _gap(data, min(end, at + stretch), end)
            yield row, data[at:to], np.array([0, to - at])
            at = to
        row += 1


def _gap(data: np.ndarray, at: int, end: int) -> int:
    """The first place from `at` on that holds white space, or end."""
    while at < end:
        found = np.flatnonzero(_SPACE[data[at : min(end, at + 4096)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return end


def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of the characters U+00C0 to U+017F as two bytes, and their classes; by 64 times (lead - 0xC3) + the second byte."""
    low, kind = np.zeros((192, 2), dtype=np.uint8), np.full(192, LETTER, dtype=np.uint8)
    for i in range(192):
        c = chr(0xC0 + i)
        raw = c.lower().encode()
        if len(raw) != 2:
            raw, kind[i] = c.encode(), ODD
        elif not c.isalpha():
            kind[i] = OTHER
        low[i] = list(raw)
    return low, kind


#: Classes of bytes: white space, letters, digits, others; and odd ones, whose chunk is left whole.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_LATIN, _LATIN_KIND = _latin()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, ODD, dtype=np.uint8)
_KIND[33:127] = OTHER
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[_SPACE] = SPACE


def pieces(data: np.ndarray, starts: np.ndarray, contractions: bool = True, special: bytes = b"|>") -> tuple[np.ndarray, ...]:
    """(text, begin, end, class, pieces before each row and after the last); starts as from stretches.

    The text is data in lower case. Pieces are runs of letters, single digits, contractions at an
    apostrophe ('s 't 'm 'd 're 've 'll), if asked for, and runs of other characters. Classes and lower case are
    known for printable ASCII and U+00C0 to U+017F. A chunk between white space with any other
    character, or with the two bytes `special`, is one piece of class ODD in its own case.
    """
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < n]
    if len(lead):
        code = (data[lead].astype(np.int64) - 0xC3) * 64 + (data[lead + 1] & 63)
        low[lead], low[lead + 1] = _LATIN[code, 0], _LATIN[code, 1]
        kind[lead] = kind[lead + 1] = _LATIN_KIND[code]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    odd = kind == ODD
    mark = np.flatnonzero((data[:-1] == special[0]) & (data[1:] == special[1]))
    odd[mark] = True
    if odd.any():
        inside = kind != SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hit = np.flatnonzero(np.bincount(np.searchsorted(b, np.flatnonzero(odd), side="right") - 1, minlength=len(b)))
        step = np.zeros(n + 1, dtype=np.int8)
        step[b[hit]] += 1
        step[e[hit]] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8) > 0
        kind[whole] = ODD
        low[whole] = data[whole]
    begin = kind != SPACE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | edge[1:-1]
    quote = np.flatnonzero((low == 39) & (kind == OTHER) & begin) if contractions else np.empty(0, np.int64)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        one = low[quote + 1]
        more = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & (kind[more] == LETTER) & ~edge[quote + 2], low[more], 0)
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, [115, 116, 109, 100])
        for at, k in ((quote[short], 2), (quote[long], 3)):
            begin[at + 1] = False
            after = at + k
            after = after[after < n]
            begin[after[(kind[after] == LETTER) & ~edge[after]]] = True
    end = kind != SPACE
    end[:-1] &= (kind[1:] == SPACE) | begin[1:]
    b = np.flatnonzero(begin)
    return low, b, np.flatnonzero(end) + 1, kind[b], np.searchsorted(b, starts)


def ragged(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches pool[at : at + n] one after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at - (ends - n), n) + np.arange(total)]


class Keys:
    """Distinct 32-bit keys to numbers, fixed when made; `missing` elsewhere. Open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.missing = missing
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, missing, dtype=np.int32)
        left, self.probes = np.arange(len(keys)), 0
        keys = keys.astype(np.int64)
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several that want a slot, one gets it
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left = left[~won]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * 2654435769) & 0xFFFFFFFF) >> (32 - self.bits)) + probe & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], self.missing)
        left = np.flatnonzero((there != keys) & (there != -1))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(keys[left], probe)
            there = self.keys[slot]
            got = there == keys[left]
            out[left[got]] = self.values[slot[got]]
            left = left[~got & (there != -1)]
        return out


class WordTable:
    """Byte strings to numbers from 0, exactly: a word of up to WIDTH bytes is its own key.

    `learn` gets (text, begin, end, odd) of pieces that aren't there yet, each once, and returns the
    number of the first; the others follow in order. Numbers point into whatever the owner keeps.
    Past `limit` words the table begins again with the words that were met more than once: `restart`
    is told which numbers stay, and these are counted from 0 in that order. Words of over KEPT bytes
    are learned each time.
    """

    KEPT = 256

    def __init__(self, learn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], int], restart: Callable[[np.ndarray], None], limit: int):
        self.learn, self.restart = learn, restart
        self.bits = max(8, int(limit * 2 - 1).bit_length())
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.head, self.tail = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.value = np.full(size, -1, dtype=np.int32)
        self.again = np.zeros(size, dtype=bool)
        self.long: dict[bytes, int] = {}
        self.held = 0

    def _slot(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return (mixed(head + tail * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _probed(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The slot of each word that the arrays hold, -1 for others."""
        slot = self._slot(head, tail)
        same = (self.head[slot] == head) & (self.tail[slot] == tail)
        empty = self.value[slot] < 0
        out = np.where(same & ~empty, slot, -1)
        left = np.flatnonzero(~same & ~empty)
        while len(left):
            s = slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            same = (self.head[s] == head[left]) & (self.tail[s] == tail[left])
            empty = self.value[s] < 0
            out[left[same & ~empty]] = s[same & ~empty]
            left = left[~same & ~empty]
        return out

    def _put(self, head: np.ndarray, tail: np.ndarray, value: np.ndarray, again: bool = False) -> None:
        """Distinct new words into the arrays."""
        slot = self._slot(head, tail)
        left = np.arange(len(head))
        while len(left):
            s = slot[left]
            free = self.value[s] < 0
            self.value[s[free]] = value[left[free]]  # of several that want a slot, one gets it
            won = self.value[s] == value[left]
            self.head[s[won]], self.tail[s[won]], self.again[s[won]] = head[left[won]], tail[left[won]], again
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.held += len(head)

    def seed(self, found: list[bytes], first: int = 0) -> None:
        """Adds words, none twice and none of over WIDTH bytes, that are numbered from `first`; they count as met before."""
        pair = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in found), dtype="<u8").reshape(-1, 2)
        self._put(pair[:, 0], pair[:, 1], first + np.arange(len(found)), True)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.again & (self.value >= 0))
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        head, tail, numbers = self.head[kept], self.tail[kept], self.value[kept]
        self._clear()
        self.restart(numbers)
        self._put(head, tail, np.arange(len(numbers)))

    def look_up(self, column: pa.Array, kinds: tuple[int, ...] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, rows after it, numbers) of the column's pieces in order: of all classes, or of the given ones without contractions.

        Numbers are good until the next step only, since the table may begin again in between.
        """
        for row, data, starts in stretches(column):
            if not len(data):
                continue
            text, b, e, kind, before = pieces(data, starts, kinds is None)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(before))
            if kinds is not None:
                keep = np.isin(kind, kinds)
                b, e, kind, owner = b[keep], e[keep], kind[keep], owner[keep]
            text = np.concatenate((text, np.zeros(WIDTH + 8, np.uint8)))
            eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=text, strides=(1,))
            zeros = np.concatenate(([0], np.cumsum(data == 0))) if (data == 0).any() else None
            for lo in range(0, len(b), self.limit // 2):
                part = slice(lo, lo + self.limit // 2)
                yield row, owner[part], self._numbers(text, eight, zeros, b[part], e[part], kind[part] == ODD)

    def _numbers(self, text: np.ndarray, eight: np.ndarray, zeros: np.ndarray | None, b: np.ndarray, e: np.ndarray, odd: np.ndarray) -> np.ndarray:
        if self.held >= self.limit:
            self._shrink()
        n = e - b
        head = eight[b] & _CUT[np.minimum(n, 8)]
        tail = eight[np.minimum(b + 8, len(eight) - 1)] & _CUT[np.clip(n - 8, 0, 8)]
        short = n <= WIDTH
        if zeros is not None:  # a zero byte and padding can't be told apart
            short &= zeros[e] == zeros[b]
        out = np.full(len(b), -1, dtype=np.int64)
        slot = self._probed(head, tail)
        there = np.flatnonzero(short & (slot >= 0))
        out[there] = self.value[slot[there]]
        self.again[slot[there]] = True
        new = np.empty(0, dtype=np.int64)
        miss = np.flatnonzero(short & (slot < 0))
        if len(miss):
            order = miss[np.lexsort((tail[miss], head[miss]))]
            fresh = np.concatenate(([True], (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1])))
            new = order[fresh]
        far = np.flatnonzero(~short)
        own: dict[bytes, int] = {}
        firsts = []
        raw = memoryview(text)
        for i, x, y in zip(far.tolist(), b[far].tolist(), e[far].tolist(), strict=True):
            w = bytes(raw[x:y])
            k = self.long.get(w)
            if k is None:
                k = own.get(w)
                if k is None:
                    k = own[w] = -2 - len(own)
                    firsts.append(i)
            out[i] = k
        asked = np.concatenate((new, np.array(firsts, dtype=np.int64)))
        if len(asked):
            base = self.learn(text, b[asked], e[asked], odd[asked])
            if len(new):
                out[order] = base + np.cumsum(fresh) - 1
                self._put(head[new], tail[new], base + np.arange(len(new)))
            if own:
                base += len(new)
                late = far[out[far] < -1]
                out[late] = base - 2 - out[late]
                self.long.update((w, base - 2 - k) for w, k in own.items() if len(w) <= self.KEPT)
                self.held += len(own)
        return out
