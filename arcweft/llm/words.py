"""Words of whole Arrow batches in numpy: no loop over words, memory bounded by SLICE bytes or the longest text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time. A longer text is a slice of its own.
SLICE = 1 << 21
#: Fixed: the bytes that part words (space, and tab to carriage return).
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of pairs in their order."""
    return mix(mix(a, 1) + b, seed)


#: Runs of more bytes are hashed one by one, by the library.
LONG_RUN = 1024
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of bytes: every 8 bytes are mixed into what came before, in no linear way, so no
    pattern of letters makes two runs collide. Runs of one size up to 8 bytes have different hashes for certain."""
    size = end - start
    h = mix(size.astype(np.uint64), 5)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.uint64, padded.data, strides=(1,))  # the 8 bytes from each byte on
    live = np.flatnonzero((size > 0) & (size <= LONG_RUN)) if len(size) else np.zeros(0, np.int64)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Runs:
    """Hashes of runs of a sequence of hashes, by doubling: a run is the two runs of a power of two that begin and end it."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def level(self, p: int) -> np.ndarray:
        while len(self.levels) <= p:
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(low[:-step], low[step:], 2) if len(low) > step else low[:0])
        return self.levels[p]

    def of(self, start: np.ndarray, length: np.ndarray | int, seed: int = 0) -> np.ndarray:
        """Hashes of the runs of `length` (at least 1) values from each start."""
        length = np.broadcast_to(np.asarray(length, np.int64), start.shape)
        out = np.zeros(len(start), np.uint64)
        power = np.frexp(length.astype(np.float64))[1] - 1
        for p in np.unique(power).tolist():
            at = np.flatnonzero(power == p)
            low, first, size = self.level(p), start[at], length[at]
            out[at] = joined(low[first] + size.astype(np.uint64), low[first + size - (1 << p)], seed)
        return out


class Texts:
    """Some whole texts: `data` their bytes end to end, `offsets` where each begins and the last ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self, lower: bool = False, gaps: np.ndarray = GAPS) -> Words:
        return Words(self, LOWER[self.data] if lower else self.data, gaps)


class Words:
    """`start` and `end` (bytes) of every word, `doc` its text, `first` each text's first word and the number of words.

    `breaks`: bytes before which a word ends, besides the gaps."""

    def __init__(self, texts: Texts, data: np.ndarray, gaps: np.ndarray, breaks: np.ndarray | None = None):
        self.texts, self.data = texts, data
        n = len(data)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = gaps[data]
        edge = np.zeros(n + 1, bool)
        edge[texts.offsets] = True
        if breaks is not None:
            edge[breaks] = True
        inside = ~gap
        self.start = np.flatnonzero(inside[1:-1] & (gap[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (gap[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)


def slices(text: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of a column (null: empty) in runs of at most `limit` bytes or one text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
