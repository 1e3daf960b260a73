"""Vectorised word splitting and hashing over Arrow string arrays.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word's hash sums a pseudorandom number for each
(place, byte), which no regular text cancels out; hashes of windows are Rabin-Karp polynomials of word hashes.  All
arithmetic is modulo 2**64 on whole byte buffers, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes looked at together; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE))
_powers: dict[int, np.ndarray] = {}
_places: list[np.ndarray] = []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(n + n // 8, base, U64)
        have[:1] = 1
        have = _powers[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def places(n: int) -> np.ndarray:
    """A pseudorandom number for each place 0 .. n-1, kept between calls."""
    if not _places or len(_places[0]) < n:
        _places[:] = [mix((np.arange(n + n // 8 + 64, dtype=U64) + U64(1)) * U64(OTHER_BASE))]
    return _places[0][:n]


def tidy() -> None:
    """Gives back what a Python worker holds; workers outlive their tasks."""
    _powers.clear()
    _places.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """run, a function of Arrow batches, with tidy() after its last batch."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return inner


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:], dtype=U64)
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def sums_by_place(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of values; the runs, of these lengths, follow each other.  0 for an empty run."""
    out = np.zeros(len(length), U64)
    some = length > 0
    if some.any():
        first = np.cumsum(length) - length
        place = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
        place -= np.repeat(first.astype(place.dtype), length)
        each = values ^ places(int(length.max()))[place]
        each *= U64(WORD_BASE)
        each ^= each >> U64(32)
        out[some] = mix(np.add.reduceat(each, first[some]) + length[some].astype(U64))
    return out


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range of a buffer; the ranges ascend and do not overlap."""
    length = end - start
    if int(length.sum()) < len(data):
        edge = np.zeros(len(data) + 1, np.int8)
        some = length > 0
        edge[start[some]] = 1
        edge[end[some]] -= 1
        data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return sums_by_place(_BYTE_VALUE[data], length)


def prefix_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cheaper hash of each byte range, which regular bytes may confuse: for those who compare the bytes after it."""
    return _between(_prefix(_BYTE_VALUE[data], BYTE_BASE), start, end, BYTE_BASE) + (end - start).astype(U64)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, stop) row ranges of about `most` bytes each."""
    size = np.frombuffer(texts.cast(pa.large_string()).buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Words of every text of a string array: `first[d]:first[d + 1]` are those of text d."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        n = len(texts)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if n and buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.n_docs, self.offsets, self.data = n, offsets, data
        word = ~_SPACE[data]
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            some = offsets[1:] > offsets[:-1]
            at, last = offsets[:-1][some], offsets[1:][some] - 1
            begins[at], ends[last] = word[at], word[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = hash_ranges(data, self.start, self.end)

    def windows(self, n: int, base: int = WORD_BASE, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word index at which each window of n words starts, and its hash; short: a text of fewer words, but not none, is one window."""
        end = np.minimum(np.arange(len(self.start)) + n, self.first[self.doc + 1]) if len(self.start) else np.zeros(0, np.int64)
        at = np.arange(len(self.start))
        whole = end - at == n
        if short:
            whole |= (self.count[self.doc] < n) & (at == self.first[self.doc])
        at, end = at[whole], end[whole]
        return at, mix(_between(_prefix(self.hash, base), at, end, base) + (end - at).astype(U64))
