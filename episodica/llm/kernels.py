"""Array kernels that work on a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 2**64)
CHUNK = 1 << 21

_letters = np.zeros(256, np.uint64)
_seed = np.random.default_rng(7).integers(1, 2**63, 36, dtype=np.int64).astype(np.uint64)
_letters[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = _seed | np.uint64(1)
_is_word = _letters > 0

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < size:
        size = max(size, CHUNK)
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(_BASE))
            up[0] = 1
            down = np.full(size, np.uint64(_BASE_INV))
            down[0] = 1
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[0] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of about CHUNK characters; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of a-z and 0-9 in the lower-cased text) of all texts in one pass.

    Returns a 64-bit hash for each word, and for each text the range [first, last) of its words.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _is_word[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_letters[buf] * up[: len(buf)], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        hashes = mix((total[stops - 1] - before) * down[starts])
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]]) if len(last) else last
    return hashes, first, last


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ hashes[j : j + n]) * _ODD
            out ^= out >> np.uint64(29)
    return mix(out)


def string_hash(values: list[str]) -> np.ndarray:
    """A 64-bit hash of each whole string, stable across processes."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values), np.uint64, len(values))


def binary_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose i-th value holds counts[i] elements of ``data``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * data.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def binary_values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a binary column end to end, and each value's range as offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(raw):
        return np.zeros(0, dtype), np.zeros(len(column) + 1, np.int64)
    values = np.frombuffer(data, np.uint8)[raw[0] : raw[-1]].view(dtype)
    return values, (raw - raw[0]) // size


def grouped_positions(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive groups of the given sizes."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
