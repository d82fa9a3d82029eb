"""Words, lines and their 64-bit hashes from Arrow text, without a Python loop per row.

A batch is worked on in slices of about ``SLICE_BYTES``, so the arrays of a
task do not grow with the batch. A longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_UNRADIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE[LOWER]
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= _RADIX
    h ^= h >> np.uint64(32)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, base in enumerate((_RADIX, _UNRADIX)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code times radix^position; a substring's hash is a scaled difference."""
    up, _ = _power_tables(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def byte_prefix(data: np.ndarray, lower: bool) -> np.ndarray:
    """The same of the codes of bytes."""
    return prefix_sums((_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data])


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def windows_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """The same of every span of ``width`` bytes."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[width:] - prefix[:-width]) * down[: len(prefix) - width])


@dataclass
class Slice:
    """Some texts of a batch: rows first..last, their bytes and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut an Arrow string array into slices; a null text is an empty one."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        low, high = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[low:high], offsets[first : last + 1] - low)
        first = last


def word_spans(part: Slice, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each row (one more at the end)."""
    n = len(part.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(part.rows + 1, np.int64)
    inside = ~separator[part.data]
    bounds = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[bounds] |= inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] |= inside[bounds - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, part.offsets)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row and the rows' bounds among them.

    A row with fewer words, but not none, has its whole sequence as its only run.
    """
    counts = np.diff(bounds)
    rows = row_of(bounds)
    n = len(hashes)
    at = np.arange(n)
    room = bounds[1:][rows] - at
    out = np.zeros(n, np.uint64)
    for j in range(k):
        step = np.zeros(n, np.uint64)
        step[: max(n - j, 0)] = hashes[j:]
        step[room <= j] = 0
        out = (out + step) * _RADIX + np.uint64(j + 1)
    begins = (room >= k) | ((counts[rows] < k) & (at == bounds[:-1][rows]))
    kept = np.flatnonzero(begins)
    return mix(out[kept]), np.searchsorted(kept, bounds)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the rows' bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, where each stands first, and for every key which of them it is.

    Only the different ones are sorted, so this is for keys that repeat often.
    """
    coded = pc.dictionary_encode(pa.array(keys))
    kinds, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = np.arange(len(keys) - 1, -1, -1)
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    return kinds[order], first[order], place[which]


def salted(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes that also depend on the row, so that rows can be told apart after one sort."""
    return mix(hashes ^ mix(row_of(bounds).astype(np.uint64) + np.uint64(1)))
