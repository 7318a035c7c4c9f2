"""Texts of an Arrow batch as one byte array, with words and rolling hashes computed in NumPy.

A batch is cut into chunks of bounded bytes (a single longer text is a chunk of its own), so the
memory of a task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
# Odd multipliers of 64-bit mixing; any odd numbers do.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the row offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with at most ``limit`` bytes of text (or one row), bytes and offsets."""
    for batch in batches:
        data, bounds = raw_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[bounds[at]: bounds[end]], bounds[at: end + 1] - bounds[at]
            at = end


def word_spans(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes other than those ``between`` (ASCII white space)."""
    solid = ~between[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.r_[False, solid[:-1]]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.r_[solid[1:], False]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * CHUNK_BYTES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; only those for a usual chunk are kept."""
    up, down = _usual_powers() if n <= 2 * CHUNK_BYTES else _powers(n)
    return up[:n], down[:n]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h[i]`` sums value(byte) * base**place over the first ``i`` bytes, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_values()[data] * up[: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, independent of its place."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mixed((prefix[ends] - prefix[starts]) * down[starts])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes, in order; row borders are the caller's."""
    count = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(count, n, np.uint64)
        for i in range(n):
            out = mixed(out * MIX_B + words[i: i + count])
    return out


def within_rows(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether the window of ``n`` items that begins at each place stays in one row."""
    count = max(0, len(rows) - n + 1)
    return rows[:count] == rows[n - 1: n - 1 + count]


def split_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of equal values."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    return first, np.r_[first[1:], len(values)].astype(np.int64)[: len(first)]


def addressed(keys: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple]:
    """One packed row per destination: its number, then the keys and columns that go there as bytes."""
    target = (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    first, stop = split_sorted(target[order])
    return [(int(target[order[i]]), *(c[order[i:j]].tobytes() for c in (keys, *columns))) for i, j in zip(first, stop)]
