"""Arrow and numpy helpers of the operators that run in Python tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20
#: Words of up to 64 bytes are hashed side by side.
LANES = 8
_SEED = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` of at most ``limit`` bytes of text together (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``; when it has ended, free memory goes back to the system. A worker stays for other tasks, more of them than cores."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def filled(column: pa.Array) -> pa.Array:
    """Texts as a compact array of their own, null as empty."""
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row bounds, words ``[^\\x20\\x09-\\x0D]+`` of all rows one after another)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end gives empty words
        kept = np.concatenate([[0], np.cumsum(real)])
        bounds, flat = kept[bounds - bounds[0]], flat.filter(pa.array(real))
    return bounds - bounds[0], flat


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, .. of each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time; words of over ``LANES`` times eight bytes by themselves."""
    flat = flat.cast(pa.large_binary())
    _, ends, data = flat.buffers()
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(ends, np.int64, n + 1, 8 * flat.offset)
    start, size = ends[:-1], np.diff(ends)
    base = int(start[0])
    text = np.zeros(int(ends[-1]) - base + 8, np.uint8)
    if data is not None:
        text[:-8] = np.frombuffer(data, np.uint8, len(text) - 8, base)
    eight = np.ndarray(len(text) - 7, np.dtype("<u8"), text, 0, (1,))  # the eight bytes from each byte on
    start = start - base
    h = mixed(size.astype(np.uint64) + _SEED)
    rows = np.flatnonzero(size <= 8 * LANES)
    with np.errstate(over="ignore"):
        for k in range(LANES):
            rows = rows[size[rows] > 8 * k]
            if not len(rows):
                break
            left = np.minimum(size[rows] - 8 * k, 8).astype(np.uint64)
            lane = eight[start[rows] + 8 * k] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))
            h[rows] = mixed((h[rows] ^ lane) * _SEED)
    long = np.flatnonzero(size > 8 * LANES)
    if len(long):
        h[long] = byte_hashes(flat.take(pa.array(long)))
    return h


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries, in order; shorter by ``width - 1``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mixed(out)
