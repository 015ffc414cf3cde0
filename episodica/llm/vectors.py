"""Usable vectors of a table: finite, of the stated length, not all zero, scaled to length 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a list column, as float64, and their indices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    keep = np.flatnonzero(lengths == dim)
    if not len(keep):
        return np.zeros((0, dim)), keep
    flat = column.take(pa.array(keep)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[ok], keep[ok]


def unit_vectors(df: DataFrame, *, id_col: str, vector_col: str, scope_col: str | None, dim: int) -> DataFrame:
    """(id, scope, node, vec): ``node`` is a hash of scope and direction, ``vec`` the unit vector as dim float32."""
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    rows = df.select(F.col(id_col).alias("id"), scope.alias("scope"), F.col(vector_col).alias("v")).where("id is not null and scope is not null and v is not null")
    kind = dict(rows.dtypes)["id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            odd = kernels.mix(np.arange(1, dim + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            x, keep = matrix(b.column("v"), dim)
            if not len(keep):
                continue
            x /= np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype("<f4") + np.float32(0)
            at = pa.array(keep)
            scopes = b.column("scope").take(at)
            with np.errstate(over="ignore"):
                node = kernels.mix((kernels.mix(x.view("<u4").astype(np.uint64)) * odd).sum(axis=1, dtype=np.uint64) ^ kernels.string_hash(scopes.to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), scopes, pa.array(node.view(np.int64)), kernels.binary_column(x.ravel(), np.full(len(x), dim))], names=["id", "scope", "node", "vec"])

    return rows.mapInArrow(build, f"id {kind}, scope string, node long, vec binary")


def rows_of(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    return kernels.binary_values(column, dtype)[0].reshape(-1, dim)
