"""Words of a batch of texts as arrays: where they are, which text they belong to, and 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Hashes
are polynomials over the bytes with wrapping arithmetic, finished by a mixer; they are equal in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK = 1 << 18  # bytes that are looked at at once, so that working arrays do not grow with a text
_POWERS = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(BLOCK - 1, BASE, dtype=np.uint64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ (right >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # where each text starts in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words

    @property
    def text(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), dtype=np.uint64)
        for lo in range(0, len(self.data), BLOCK):
            hi = min(lo + BLOCK, len(self.data))
            a, b = np.searchsorted(self.end, lo, "right"), np.searchsorted(self.start, hi)
            if a == b:
                continue
            start = np.maximum(self.start[a:b], lo) - lo
            size = np.minimum(self.end[a:b], hi) - lo - start
            before = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(before, size)  # of each byte within its word, as far as it is in the block
            terms = self.data[lo:hi][place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
            sums = np.add.reduceat(terms * _POWERS[place], before)
            if self.start[a] < lo:
                sums[:1] *= np.uint64(pow(BASE, int(lo - self.start[a]), 1 << 64))
            out[a:b] += sums
        return mix(out ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def split(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        word = ~SPACE[data[lo:hi]]
        new = np.zeros(hi - lo + 1, dtype=bool)  # where a text begins
        new[at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo] = True
        before = np.r_[lo > 0 and not SPACE[data[lo - 1]], word[:-1]]
        behind = np.r_[word[1:], hi < len(data) and not SPACE[data[hi]]]
        starts.append(np.flatnonzero(word & (~before | new[:-1])) + lo)
        ends.append(np.flatnonzero(word & (~behind | new[1:])) + lo + 1)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return Words(data, at, start, end, np.searchsorted(start, at))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and which of them lie within one text."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    powers, width = {1: hashes}, 1
    while 2 * width <= n:
        powers[2 * width] = join_hash(powers[width][:-width], powers[width][width:])
        width *= 2
    out, done = None, 0
    for width in sorted(powers, reverse=True):
        if done + width <= n:
            out = powers[width] if out is None else join_hash(out[: len(powers[width]) - done], powers[width][done:])
            done += width
    out = out[: total - n + 1]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)  # words from here to the end of the text
    return out, left[: total - n + 1] >= n
