"""Words of many texts at once: arrays of UTF-8 bytes, and a hash table of short byte strings that is probed as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longest byte string that is a key.
LONGEST = 15
#: Masks of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)] + [(1 << 64) - 1] * 7, np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, and their bounds."""
    _, places, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if places is not None else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the words of texts that lie one after another; text k is data[bounds[k]:bounds[k + 1]]."""
    held = ~_BLANK[data]
    starts, ends = held.copy(), held.copy()
    starts[1:] &= ~held[:-1]
    ends[:-1] &= ~held[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] = held[inner]
    ends[inner - 1] = held[inner - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1 - at


def segments(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds and numbers of texts, about most bytes at a time; a longer text comes in parts, cut at blanks."""
    k, at = 0, int(offsets[0])
    while k < len(offsets) - 1:
        last = int(np.searchsorted(offsets, at + most, "right")) - 1
        if last > k:
            yield data[at : offsets[last]], np.r_[at, offsets[k + 1 : last + 1]] - at, np.arange(k, last)
            k, at = last, int(offsets[last])
            continue
        end, cut = int(offsets[k + 1]), at + most
        while cut < end and not (blank := _BLANK[data[cut : min(end, cut + most)]]).any():
            cut += most
        cut = min(end, cut + int(blank.argmax())) if cut < end else end
        yield data[at:cut], np.array([0, cut - at]), np.array([k])
        k, at = (k + 1, end) if cut == end else (k, cut)


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each of some byte strings of at most LONGEST bytes."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    eights = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    return eights[starts] & _FIRST[sizes], eights[starts + 8] & _FIRST[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)


def firsts(low: np.ndarray, high: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys that were not found (-1): their places, in the order of the keys; the number of each one's key; and a place for each key."""
    new = np.flatnonzero(found < 0)
    order = new[np.lexsort((high[new], low[new]))]
    differs = np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])][: len(order)]
    return order, np.cumsum(differs) - 1, order[differs]


class Keys:
    """Numbers entries from 0 on, some of which have a key: a hash table of 16-byte keys."""

    def __init__(self, most: int):
        self.most, self.bits = most, most.bit_length() + 1
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high, self.n = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), 0

    def _homes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        out = np.full(len(low), -1, np.int32)
        at = self._homes(low, high)
        entry = self.slots[at]
        todo = np.flatnonzero(entry >= 0)
        entry, at = entry[todo], at[todo]
        while len(todo):
            same = (self.low[entry] == low[todo]) & (self.high[entry] == high[todo])
            out[todo[same]] = entry[same]
            todo, at = todo[~same], at[~same] + 1 & len(self.slots) - 1
            entry = self.slots[at]
            full = entry >= 0
            todo, at, entry = todo[full], at[full], entry[full]
        return out

    def room(self, k: int) -> None:
        """Makes room for k more entries."""
        while self.n + k > len(self.low):
            self.low, self.high = (np.r_[v, np.zeros_like(v)] for v in (self.low, self.high))

    def name(self, first: int, low: np.ndarray, high: np.ndarray) -> None:
        """Gives keys, which are distinct and new, to the entries from first on."""
        k = len(low)
        self.low[first : first + k], self.high[first : first + k] = low, high
        at, entry = self._homes(low, high), np.arange(first, first + k, dtype=np.int32)
        while len(at):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = entry[free]  # of several that want a slot one gets it
            lost = self.slots[at] != entry
            at, entry = at[lost] + 1 & len(self.slots) - 1, entry[lost]
