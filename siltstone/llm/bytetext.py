"""Numpy kernels over the UTF-8 bytes of a block of texts: words, lines, hashes, shingle sets.

A block is a run of whole texts of about BLOCK bytes (one text alone where it is longer), so memory
follows the longest text and not the table. Words are runs of bytes other than 0x20 and 0x09-0x0D.
Within a text, words, lines and shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longer ranges are hashed by xxh64, one at a time.
MOST_LANES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; null counts as empty."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Hasher:
    """64-bit hashes of ranges of one block of bytes or code points, eight bytes at a time.

    Every step scrambles what came before, so no pattern of letters brings two ranges together, as it
    would in a polynomial modulo a power of two. Ranges of up to eight bytes without a zero at the end
    differ in their hash for sure. Ranges over MOST_LANES steps are hashed by xxh64.
    """

    def __init__(self, data: np.ndarray):
        self.item = data.itemsize
        self.step = 8 // self.item
        self.bytes = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(data) + 1,), "<u8", self.bytes, strides=(self.item,))
        self.masks = np.array([(1 << 8 * self.item * i) - 1 for i in range(self.step + 1)], np.uint64)

    def lane(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first eight bytes from each start, zero from size on."""
        return self.lanes[start] & self.masks[np.minimum(size, self.step)]

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
        """Whether the ranges of these sizes from a and from b are equal, each to each."""
        left, done = np.flatnonzero(a != b), 0
        view = memoryview(self.bytes)
        while len(left) and done < self.step * MOST_LANES:
            x, y, n = a[left] + done, b[left] + done, size[left] - done
            if (self.lane(x, n) != self.lane(y, n)).any():
                return False
            done += self.step
            left = left[size[left] > done]
        part = lambda at, n: view[int(at) * self.item : int(at + n) * self.item]
        return all(part(a[i], size[i]) == part(b[i], size[i]) for i in left)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix((size.astype(np.uint64) + np.uint64(1)) * ODD ^ mix(self.lane(start, size)))
        done, most = self.step, self.step * MOST_LANES
        left = np.flatnonzero((size > done) & (size <= most))
        while len(left):
            h[left] = mix(h[left] * ODD ^ mix(self.lane(start[left] + done, size[left] - done)))
            done += self.step
            left = left[size[left] > done]
        view = memoryview(self.bytes)
        for i in np.flatnonzero(size > most):
            h[i] = xxhash.xxh64_intdigest(view[int(start[i]) * self.item : int(end[i]) * self.item])
        return h


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that gap doesn't mark; a run never crosses texts."""
    full = ~gap
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = full.copy()
    start[1:] &= gap[:-1] | cut[1:-1]
    end = full
    end[:-1] &= gap[1:] | cut[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def text_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


class Words:
    """The words of one block: start, end, text number, hash, and first word and count by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n = len(offsets) - 1
        data = LOWER[data] if lower else data
        self.data, self.gap = data, SPACE[data]
        self.start, self.end = spans(data, offsets, self.gap)
        self.text = text_of(offsets, self.start)
        self.hasher = Hasher(data)
        self.hash = self.hasher(self.start, self.end)
        self.first = np.searchsorted(self.text, np.arange(self.n + 1))
        self.count = np.diff(self.first)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k words in a row; the whole sequence where it is shorter."""
    h = words.hash
    chain = h.copy()
    for i in range(1, k):
        chain = chain[:-1] if len(chain) else chain
        chain = mix(chain * ODD + h[i : i + len(chain)])
    out = []
    for t in range(words.n):
        a, m = int(words.first[t]), int(words.count[t])
        if m >= k:
            out.append(np.unique(chain[a : a + m - k + 1]))
        elif m:
            one = h[a : a + 1]
            for i in range(1, m):
                one = mix(one * ODD + h[a + i : a + i + 1])
            out.append(mix(one + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
