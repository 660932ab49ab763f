"""NumPy helpers for tasks that work on the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that one round of NumPy work covers; a longer text is a round of its own.
ROUND = 2_000_000
# Multipliers of the rolling hashes (odd 64-bit numbers) and of the finaliser.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def rounds(column: pa.Array, limit: int = ROUND) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``limit`` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def tidy() -> None:
    """Give freed memory back: a worker lives on after its task, beside the executor's next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only the GNU C library has it
        pass


def whole_groups(batches, same) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by a key, cut anew so that no key is split; ``same(batch)`` tells where a key begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        joined = pa.concat_batches(held) if len(held) > 1 else batch
        begin = same(joined)
        last = int(begin[-1])
        if last:
            yield joined.slice(0, last)
        held = [joined.slice(last)]
    if held:
        yield pa.concat_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Prefix hashes modulo 2**64: the hash of any run of values costs one subtraction and one product."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.up[1:], self.down[1:] = self.base, self.inverse
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, end), mixed so that every bit depends on every value."""
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside[:-1] & (~inside[1:] | edge[1:])
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, roll: Rolling) -> np.ndarray:
    return roll.runs(roll.prefix(data.astype(np.uint64) + np.uint64(1)), start, end)


def per_text(first: np.ndarray, skip: int = 0) -> np.ndarray:
    """Text number of every word, or of every run of ``skip`` + 1 words."""
    return np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - skip, 0))


def run_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text number of every run of ``width`` words inside one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return first[:-1][text] + np.arange(len(text)) - before[text], text
