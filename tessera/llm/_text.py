"""Vectorised word kernels over Arrow string columns.

A block is a run of rows whose UTF-8 bytes lie in one buffer. Words, word hashes
and word n-gram hashes of all rows of a block are found by a few numpy passes over
the bytes, with no Python step per word. All hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_code = np.arange(256)
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` before lower-casing A-Z too.
ALNUM = (_code >= 128) | ((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122))
LOWER = _code.astype(np.uint8)
LOWER[65:91] += 32

_M = np.uint64(0xD6E8FEB86659FD93)
_LANE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xA0761D6478BD642F)
#: What is kept of eight bytes when only so many belong to the span.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LANES_AT_ONCE = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES):
    """Yield (first row, bytes, offsets) for runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = np.int64 if column.type == pa.large_string() else np.int32
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a row's bounds."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = offs[(offs > 0) & (offs < n)]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    before[at] = False
    after[at - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yield (spans, places, lanes): the eight-byte lanes of byte spans, in runs of bounded size.

    ``spans`` names the span of each lane and ``places`` its number within the span; bytes
    past a span's end are zero. Spans are in order; a long one is spread over several runs.
    """
    size = ends - starts
    upto = np.cumsum((size + 7) >> 3)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    for lo in range(0, int(upto[-1]) if len(upto) else 0, LANES_AT_ONCE):
        hi = min(lo + LANES_AT_ONCE, int(upto[-1]))
        first, last = np.searchsorted(upto, [lo, hi - 1], "right")
        many = np.diff(np.clip(upto[first : last + 1], lo, hi), prepend=lo)
        spans = np.repeat(np.arange(first, last + 1), many)
        places = np.arange(lo, hi) - (upto[spans] - ((size[spans] + 7) >> 3))
        at = starts[spans] + 8 * places
        yield spans, places, wide[at] & _KEEP[np.minimum(ends[spans] - at, 8)]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand.

    Every lane of eight bytes is mixed with its place in the span by a non-linear function
    and the lanes' values are added up, so patterns of bytes don't cancel each other out.
    ``seed`` chooses another function of the same kind.
    """
    total = np.zeros(len(starts), np.uint64)
    salt = mix(np.array([seed], np.uint64))[0] if seed else np.uint64(0)
    for spans, places, lanes in span_lanes(data, starts, ends):
        value = mix(lanes ^ mix((places + 1).astype(np.uint64) * _LANE + salt))
        first = np.flatnonzero(np.diff(spans, prepend=-1))
        total[spans[first]] += np.add.reduceat(value, first)
    return mix(total + (ends - starts).astype(np.uint64) * _LENGTH + salt)


class Words:
    """Words of the rows of a block: byte spans, hashes, and each row's range of words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, members: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = runs(members[data], offs)
        self.bounds = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.bounds)
        self.hash = span_hash(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.counts)

    def grams(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, bounds, first words) of the k-word windows of each row.

        ``short``: a row of fewer words, but not none, has its whole sequence as one
        window; its hash depends on the number of words too.
        """
        n, wh = len(self.hash), self.hash
        per = np.maximum(self.counts - k + 1, 0)
        few = (self.counts > 0) & (self.counts < k) & short
        bounds = np.concatenate([[0], np.cumsum(per + few)])
        out, first = np.empty(bounds[-1], np.uint64), np.empty(bounds[-1], np.int64)
        if n >= k:
            rolled = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                rolled *= _M
                rolled += wh[j : n - k + 1 + j]
            long = np.flatnonzero(per)
            at = np.repeat(self.bounds[long] - np.concatenate([[0], np.cumsum(per[long])[:-1]]), per[long]) + np.arange(per[long].sum())
            to = np.repeat(bounds[long] - np.concatenate([[0], np.cumsum(per[long])[:-1]]), per[long]) + np.arange(per[long].sum())
            out[to] = mix(rolled[at] + np.uint64(k))
            first[to] = at
        rows = np.flatnonzero(few)
        if len(rows):
            acc = np.zeros(len(rows), np.uint64)
            for j in range(k - 1):
                has = self.counts[rows] > j
                acc[has] = acc[has] * _M + wh[self.bounds[rows[has]] + j]
            out[bounds[rows]] = mix(acc + self.counts[rows].astype(np.uint64))
            first[bounds[rows]] = self.bounds[rows]
        return out, bounds, first


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def tidy(function, tokens: bool = False):
    """``function`` over a task's batches, giving memory back when the task ends.

    Python workers are used again by later tasks; what one leaves behind would add to the
    peak of the next. ``tokens``: keep the encoders, which the next task may use.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            held = sys.modules.get("tessera.llm._tokens")
            if held is not None and not tokens:
                held._encoders.clear()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run
