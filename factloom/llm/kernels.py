"""Vectorised text kernels for Arrow batches: word bounds, span hashes and window hashes.

All work on the UTF-8 bytes of a column, a bounded block at a time, so a task holds a few blocks and never a
partition. Word classes are ASCII sets; every byte of a non-ASCII character counts as part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes worked on at once; a single longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be inverted modulo 2**64
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))
_WINDOW = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


# bytes of [^\x20\x09-\x0D] and of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
SOLID = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALPHANUMERIC = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_FOLDED = _EXACT[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for at, base in ((0, _STEP), (1, _UNSTEP)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers


class Block(NamedTuple):
    """Texts of some rows: their bytes end to end and the ``n + 1`` bounds."""

    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of a block: byte bounds, and per row the first word (``n + 1`` values)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def block_of(column) -> Block:
    """Bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return Block(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Block(raw[bounds[0]:bounds[-1]], bounds - bounds[0])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` text bytes each; at least one row per slice."""
    sizes = np.diff(block_of(batch.column(batch.schema.get_field_index(column))).bounds)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def find_words(block: Block, inside: np.ndarray = SOLID) -> Words:
    """Bounds of all maximal runs of ``inside`` bytes; no word crosses a row."""
    data, bounds = block
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    solid = inside[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    heads = bounds[:-1][bounds[:-1] < n]
    opens[heads] = solid[heads]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = solid[tails]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds))


class SpanHash:
    """64-bit hashes of any byte spans of a block from one prefix sum."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[data] * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive values, built by doubling; ``len - length + 1`` values, not yet mixed by row."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    out, have, rest = None, 0, length
    power, size = words, 1
    while rest:
        if rest & 1:
            # prepend what is held, then the current power of two
            out = power if out is None else out[:len(out) - size] + power[have:] * _pow(have)
            have += size
        rest >>= 1
        if rest:
            power = power[:-size] + power[size:] * _pow(size)
            size *= 2
    return mix(out[:len(words) - length + 1] + np.uint64(length))


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(_WINDOW), n, 1 << 64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words that stay in their row: window starts and how many each row has."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    return ranges(first[:-1], counts), counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + c) ...])``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - shift, counts)


def strings(data: bytes, bounds: np.ndarray) -> pa.Array:
    """A string column from bytes end to end."""
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]).cast(pa.string())
