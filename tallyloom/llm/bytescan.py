"""Whole texts as byte arrays inside Arrow tasks: slices of a batch, and hashes of any substring.

Everything here works on the rows of one Arrow batch at a time; memory follows the slice size. Of a longer text
the bytes themselves are one array, as they came; `span_hashes` takes its words a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text a task looks at together; some twenty arrays of 8 bytes a byte may stand at once. A longer text makes a
#: slice of its own.
SLICE_BYTES = 1 << 17

# Fixed odd multipliers of the two substring hashes (inverses below), and of the finaliser.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers: dict[tuple[int, bool], np.ndarray] = {}


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, row offsets); a NULL counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    n = len(wide)
    if n == 0:
        return
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1]
    data = wide.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


def release() -> None:
    """Give what earlier batches took back to the system: workers are used again for other stages, and Arrow's pool keeps it."""
    pa.default_memory_pool().release_unused()


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    known = _powers.get((base, inverse))
    if known is None or len(known) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        table = np.full(max(n, SLICE_BYTES + 1), step, np.uint64)
        table[0] = 1
        known = _powers[(base, inverse)] = np.multiply.accumulate(table)
        if n > 4 * SLICE_BYTES:  # a giant text must not stay in the worker's memory
            _powers.pop((base, inverse))
    return known


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of substrings of one byte array, each in constant time after one pass."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data)
        self._inverse = _power(base, n + 1, inverse=True)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, n + 1)[:n], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit hash per [start, end); equal strings have equal hashes."""
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mixed(raw + (end - start).astype(np.uint64) * _MIX_2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that follow each other without overlap, from sums over a slice's worth of bytes at a time."""
    if len(data) <= 2 * SLICE_BYTES:
        return Substrings(data).hashes(starts, ends)
    out, a = np.zeros(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")), a + 1)
        low = int(starts[a])
        out[a:b] = Substrings(data[low : int(ends[b - 1])]).hashes(starts[a:b] - low, ends[a:b] - low)
        a = b
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that end at row borders: starts, ends, and runs before each row."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch per run of equal key columns, from batches sorted by them; runs may cross batches.
    Key columns hold integers without NULLs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
        edge = np.zeros(joined.num_rows, bool)
        for k in keys:
            values = joined.column(k).to_numpy(zero_copy_only=False)
            edge[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(edge)])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield joined.slice(a, b - a)
        held = [joined.slice(int(starts[-1]))]
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()
