"""Whole-column text work in numpy: words and their hashes, straight from Arrow's buffers.

An Arrow string column is one run of UTF-8 bytes and a list of offsets. These helpers
find and hash the words of a whole batch with array operations, so that a Python worker
spends its time in numpy and not on an object for each word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLAB = 1 << 20
_PLACE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _malloc_trim() -> Callable | None:
    """The C library's call that hands free memory back, where it has one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except OSError:
        return None


def give_back() -> None:
    """Hands memory that Arrow and numpy have freed back to the system; else a worker, which serves one stage after another, keeps the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task's work on its batches, with freed memory handed back before each next batch and at the end."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(fed())
        finally:
            give_back()

    return runs


def _scrambled(n: int) -> np.ndarray:
    """n numbers without a pattern, always the same."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * _PLACE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = _scrambled(256)

_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def fold_table(keep_punctuation: bool) -> np.ndarray:
    """Maps a byte to 0 (between words) or to its lower-case form (A-Z only).

    With punctuation kept, words are runs of anything but ASCII white space; without,
    runs of ASCII letters, digits and bytes of non-ASCII characters.
    """
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = bytes([b])
        if c.isupper():
            table[b] = c.lower()[0]
        if c in _SPACE if keep_punctuation else not c.isalnum():
            table[b] = 0
    for b in _SPACE:
        table[b] = 0
    return table


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets (one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n, first = len(column), column.offset
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[first : first + n + 1] if offsets and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slabs(column: pa.Array, size: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes, as (first row, bytes, offsets). A longer row comes alone."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of folded bytes (0 stands between words); no word spans two rows."""
    inside = folded != 0
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(inside)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes; it depends on those alone. With ``prefixes`` (n, 1 + prefixes): also of so many first bytes.

    Each byte is scrambled together with its place in the word, and these numbers are
    added up. (A polynomial in one base gives some repetitive words the same hash whatever
    the base.)
    """
    out = np.empty((len(starts), 1 + len(prefixes)), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLAB, "right")))
        span = int(ends[hi - 1]) - base
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        place = np.arange(span, dtype=np.uint64)
        first = np.zeros(span, np.uint64)
        inner = s < span  # an empty word may stand at the very end
        first[s[inner]] = s[inner].astype(np.uint64)
        place -= np.maximum.accumulate(first)
        with np.errstate(over="ignore"):
            place *= _PLACE
            place += _BYTES[folded[base : base + span]]
            place ^= place >> np.uint64(31)
            place *= np.uint64(0xFF51AFD7ED558CCD)
            place ^= place >> np.uint64(29)
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(place, out=sums[1:])
            for k, n in enumerate((None, *prefixes)):
                upto = e if n is None else np.minimum(s + n, e)
                h = sums[upto] - sums[s] + (upto - s).astype(np.uint64) * _PLACE
                h ^= h >> np.uint64(33)
                h *= np.uint64(0xC4CEB9FE1A85EC53)
                h ^= h >> np.uint64(33)
                out[lo:hi, k] = h
        lo = hi
    return out if prefixes else out[:, 0]
