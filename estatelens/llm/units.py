"""Texts as sequences of short units, so that a tokenizer sees each distinct unit once.

A block of texts is cut where no token can reach across: before a single space
that a word follows, and around a single line break between words. Tokenizing
the units one by one gives the same ids as tokenizing whole texts. Units are
named by 64-bit hashes; a worker keeps the ids of units it has seen, up to a
bound, beyond which it starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from estatelens.llm.common import finish

_LONG = 256  # units with more bytes are encoded each time
_SEGMENT = 1 << 20
_POWERS = np.cumprod(np.full(_LONG, 0x9E3779B97F4A7C15, np.uint64))

# ASCII characters that are no white space, and lead bytes of characters that are none: the
# white space characters beyond ASCII begin with the bytes C2, E1, E2 and E3.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[0xE1:0xE4] = False
_SOLID_ASCII = _SOLID.copy()
_SOLID_ASCII[0x80:] = False


# For vocabularies that ignore case and white space: bytes with values that ignore them too.
_FOLDED = np.arange(1, 257, dtype=np.uint64)
_FOLDED[0x41:0x5B] = _FOLDED[0x61:0x7B]
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_FOLDED[_BLANK] = 0
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
for _c in range(0x21, 0x7F):
    _LETTER[_c] = chr(_c).isalpha()
    _MARK[_c] = not chr(_c).isalnum() and chr(_c) != "'"
# Second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def folded_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """As unit_starts for vocabularies that drop white space: after it, and between letters and marks."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        blank = _BLANK[data]
        cut[1:-1] = blank[:-1] & ~blank[1:]
        letter = _LETTER[data[:-1]]
        letter[1:] |= (data[:-2] == 0xC3) & _LATIN[data[1:-1]]
        cut[1:-1] |= letter & _MARK[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start; every text that isn't empty starts one."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        solid = _SOLID[data]
        cut[:-2] = (data[:-1] == 0x20) & solid[1:]
        alone = np.flatnonzero((data[1:-1] == 0x0A) & _SOLID_ASCII[data[:-2]] & solid[2:]) + 1
        cut[alone] = cut[alone + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def unit_names(data: np.ndarray, starts: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit names of the units; those of units that are too long mean nothing.

    With ``fold``, case and white space at the end make no difference.
    """
    ends = np.append(starts[1:], len(data))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + _SEGMENT)))
        low, high = starts[at], ends[end - 1]
        length = (ends[at:end] - starts[at:end]).astype(np.int64)
        within = np.arange(high - low) - np.repeat(starts[at:end] - low, length)
        values = _FOLDED[data[low:high]] if fold else data[low:high].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(values * _POWERS[np.minimum(within, _LONG - 1)], starts[at:end] - low)
        out[at:end] = finish(sums)
        at = end
    return out


class UnitEncoder:
    """Ids of whole texts from ids of their distinct units.

    ``encode`` gets units (bytes) and returns the ids of each as bytes of int32. ``fold``
    is for vocabularies that ignore case and white space.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], most: int = 500_000, fold: bool = False):
        self.encode, self.most, self.fold = encode, most, fold
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.ids, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, names: np.ndarray, units: list[bytes]) -> None:
        first = len(self.at) - 1
        self.ids, self.at = _appended(self.ids, self.at, self.encode(units))
        known = np.concatenate((self.known, names))
        place = np.concatenate((self.place, np.arange(first, first + len(names))))
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start."""
        low = int(offsets[0])
        data, offsets = data[low : offsets[-1]], offsets - low
        starts = (folded_starts if self.fold else unit_starts)(data, offsets)
        ends = np.append(starts[1:], len(data))
        names = unit_names(data, starts, self.fold)
        view = memoryview(data)
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.most:
            self._forget()
        slot = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = slot < len(self.known)
        missing[inside] = self.known[slot[inside]] != distinct[inside]
        missing &= (ends - starts)[first] <= _LONG
        if missing.any():
            self._learn(distinct[missing], [bytes(view[starts[i] : ends[i]]) for i in first[missing]])
        slot = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        place = self.place[slot] if len(self.known) else np.zeros(len(distinct), np.int64)
        place = place[which]
        ids, at = self.ids, self.at
        long = np.flatnonzero(ends - starts > _LONG)
        if len(long):
            own = self.encode([bytes(view[starts[i] : ends[i]]) for i in long])
            place[long] = len(at) - 1 + np.arange(len(long))
            ids, at = _appended(ids, at, own)
        count = at[place + 1] - at[place] if len(place) else np.empty(0, np.int64)
        total = np.concatenate(([0], np.cumsum(count)))
        gather = np.repeat(at[place] - total[:-1], count) + np.arange(total[-1])
        return ids[gather], total[np.searchsorted(starts, offsets)]


def _appended(ids: np.ndarray, at: np.ndarray, more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, more), np.int64, len(more)) // 4
    return (
        np.concatenate((ids, np.frombuffer(b"".join(more), np.int32))),
        np.concatenate((at, at[-1] + np.cumsum(length))),
    )
