"""Summaries of fixed size, built on the executors and merged in a stream; what reaches the driver has a fixed bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_PART = 1 << 14


def fixed_array(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], size: int, dtype: str, merge: np.ufunc) -> np.ndarray:
    """An array of ``size`` cells that every task fills for its rows and that is merged cell by cell.

    Each task sends its array in pieces of 16 Ki cells; each piece's merger holds the pieces it is
    sent one at a time, so memory is bounded by ``size`` wherever the data lie.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, dtype)
        for b in batches:
            if b.num_rows:
                fill(b, cells)
        for k in range(0, size, _PART):
            part = cells[k : k + _PART]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k // _PART], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(raw, dtype)
                if k in have:
                    merge(have[k], cells, out=have[k])
                else:
                    have[k] = cells.copy()
        for k, cells in have.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    schema = "part int, cells binary"
    rows = df.mapInArrow(build, schema).repartition(min(12, -(-size // _PART)), "part").mapInArrow(combine, schema).collect()
    out = np.zeros(size, dtype)
    for r in rows:
        part = np.frombuffer(bytes(r["cells"]), dtype)
        out[r["part"] * _PART : r["part"] * _PART + len(part)] = part
    return out


def bloom(df: DataFrame, column: str, expected: int) -> Callable[[np.ndarray], np.ndarray]:
    """A Bloom filter (at most 16 MB) of a long column as a function for use in executors' code.

    False positives only let through rows that a later join drops.
    """
    bits = 1 << min(27, max(14, int(np.ceil(np.log2(max(1, expected) * 10)))))

    def spots(x: np.ndarray) -> list[np.ndarray]:
        x = x.astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return [((x * np.uint64(m)) >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def fill(b: pa.RecordBatch, cells: np.ndarray) -> None:
        for s in spots(b.column(0).to_numpy(zero_copy_only=False)):
            np.bitwise_or.at(cells, s >> 3, (1 << (s & 7)).astype(np.uint8))

    cells = fixed_array(df.select(column), fill, bits // 8, "uint8", np.bitwise_or)
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def test(x: np.ndarray) -> np.ndarray:
        cells = shared.value
        out = np.ones(len(x), bool)
        for s in spots(x):
            out &= (cells[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0
        return out

    return test
