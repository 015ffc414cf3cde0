"""Which blocks of which hash tables the nodes of large scopes meet in, and in which wave.

A scope of up to ``bucket_rows`` nodes is one bucket of table 0; a larger one is divided by cross-polytope hashes into
buckets of about that size, in as many tables as keep the chance of missing a link at the threshold below ``miss``.
A bucket over ``block_rows`` nodes is compared in pairs of blocks. In round r block b meets block r - b (modulo the
number of blocks), so a round holds each node once at most, and a wave is a list of (table, round).

Nodes of a large bucket of table 0 have all met there; in the other tables they meet only nodes from elsewhere.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import kernels
from .vectors import rows_of


PACKED = "key long, side int, node binary, copies binary, core binary, met binary, vec binary"

#: Nodes of a packed row, and rows looked at together.
_RUN, _TAKEN = 1024, 1 << 16


def _top(x: np.ndarray) -> np.ndarray:
    at = np.abs(x).argmax(axis=1)
    return at * 2 + (x[np.arange(len(x)), at] > 0)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Layout:
    """``scopes`` has the number of nodes of each scope over ``block_rows``, ``rows`` is that of all scopes."""

    def __init__(self, scopes: dict[int, int], rows: int, *, dim: int, cos: float, bucket_rows: int, block_rows: int, miss: float, seed: int):
        self.rows, self.dim, self.block_rows, self.seed = rows, dim, block_rows, seed
        self.scope = np.array(sorted(scopes), np.int64)
        size = np.array([scopes[s] for s in self.scope.tolist()], np.int64)
        self.digits = np.ceil(np.maximum(0, np.log(np.maximum(size / bucket_rows, 1e-9))) / np.log(2 * dim)).astype(int)
        # Chance that one cross-polytope hash keeps a pair at the threshold together, measured on such pairs.
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((4000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((4000, dim))
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b = cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b, axis=1, keepdims=True)
        alike = float((_top(a) == _top(b)).mean())
        needed = {int(d): 1 if d == 0 else math.ceil(math.log(miss) / math.log(1 - alike**d)) for d in np.unique(self.digits)}
        self.scope_tables = np.array([needed[int(d)] for d in self.digits], int)
        self.tables = max([1, *needed.values()])
        self.held = [rows] + [int(size[self.scope_tables > t].sum()) for t in range(1, self.tables)]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: By table: keys, blocks and pooled blocks of large buckets; keys, first block and blocks of nodes that met before.
        self.large: dict[int, tuple] = defaultdict(lambda: none)
        self.apart: dict[int, tuple] = defaultdict(lambda: none)
        self.large_rows: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(0, np.int64))

    def divide(self, large: list[tuple[int, int, int]], apart: list[tuple[int, int, int, int]]) -> None:
        """Take note of buckets over ``block_rows`` (table, bucket, nodes) and of what more than ``block_rows`` nodes of one
        that met before (table, bucket, met, nodes) have there; the others are pooled."""
        within: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for t, bucket, met, n in sorted(apart):
            within[t, bucket].append((met, n))
        for t in sorted({x[0] for x in large}):
            keys, blocks, pooled, rows, groups = [], [], [], [], []
            for _, bucket, n in (x for x in large if x[0] == t):
                mets = within[t, bucket]
                pool = -(-(n - sum(k for _, k in mets)) // self.block_rows)
                first = pool
                for met, k in mets:
                    own = -(-k // self.block_rows)
                    groups.append((bucket, met, first, own))
                    first += own
                keys.append(bucket)
                blocks.append(first)
                pooled.append(pool)
                rows.append(n)
            keys = np.array(keys, np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.large[t] = keys[order], np.array(blocks, np.int64)[order], np.array(pooled, np.int64)[order]
            self.large_rows[t] = np.array(rows, np.int64)[order]
            g = np.array(groups, np.int64).reshape(-1, 4)
            both = self._both(g[:, 0].view(np.uint64) if len(g) else np.zeros(0, np.uint64), g[:, 1])
            order = np.argsort(both)
            self.apart[t] = both[order], g[order, 2], g[order, 3]

    def waves(self, rows: int) -> Iterator[list[tuple[int, int]]]:
        """Lists of (table, round) that hold about ``rows`` nodes together."""
        wave, size = [], 0
        for t in range(self.tables):
            blocks = self.large[t][1]
            for r in range(max([1, *blocks.tolist()])):
                n = self.held[t] if r == 0 else int(self.large_rows[t][blocks > r].sum())
                if wave and size + n > rows:
                    yield wave
                    wave, size = [], 0
                wave.append((t, r))
                size += n
        yield wave

    @staticmethod
    def _both(bucket: np.ndarray, met: np.ndarray) -> np.ndarray:
        return kernels.mix(bucket ^ kernels.mix(np.ascontiguousarray(met).view(np.uint64)))

    def _places(self, s: np.ndarray, x: np.ndarray, tables: list[int], turns: dict, every: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each table: the rows that it holds, their buckets, and the buckets of table 0 where they have all met, or 0.
        Without ``every``, rows of scopes up to ``block_rows`` are left out."""
        at, known = _found(self.scope, s)
        digits = np.where(known, self.digits[at], 0) if len(self.scope) else np.zeros(len(s), int)
        many = np.where(known, self.scope_tables[at], 1) if len(self.scope) else np.ones(len(s), int)

        def bucket(t: int, rows: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                key = kernels.mix(s[rows].view(np.uint64) + np.uint64(t))
            for d in np.unique(digits[rows]):
                of = np.flatnonzero(digits[rows] == d)
                for j in range(d):
                    if (t, j) not in turns:
                        turns[t, j] = np.linalg.qr(np.random.default_rng([self.seed, t, j]).standard_normal((self.dim, self.dim)))[0].astype(np.float32)
                    key[of] = kernels.mix(key[of] ^ _top(x[rows[of]] @ turns[t, j]).astype(np.uint64))
            return key

        first = None
        for t in tables:
            rows = np.flatnonzero((many > t) & (known | every))
            if not len(rows):
                continue
            key = bucket(t, rows)
            met = np.zeros(len(rows), np.int64)
            if t and len(self.large[0][0]):
                if first is None:
                    hashed = np.flatnonzero(many > 1)
                    first = np.zeros(len(s), np.uint64)
                    first[hashed] = bucket(0, hashed)
                _, all_met = _found(self.large[0][0], first[rows])
                met = np.where(all_met, first[rows], np.uint64(0)).view(np.int64)
            yield t, rows, key, met

    def counted(self, tables: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """(t, bucket, met, n) of batches with the columns s and vec, for scopes over ``block_rows``."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns: dict = {}
            for batch in batches:
                x = rows_of(batch.column("vec"), "<f4", self.dim)
                for t, rows, key, met in self._places(batch.column("s").to_numpy(), x, tables, turns, False):
                    order = np.lexsort((met, key))
                    key, met = key[order], met[order]
                    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (met[1:] != met[:-1])]))
                    n = np.diff(at, append=len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(key[at].view(np.int64)), pa.array(met[at]), pa.array(n.astype(np.int64))], names=["t", "bucket", "met", "n"])

        return work

    def dealt(self, units: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The block pairs of a wave, as ``PACKED`` rows: up to ``_RUN`` nodes of one key and side end to end."""
        rounds: dict[int, list[int]] = defaultdict(list)
        for t, r in units:
            rounds[t].append(r)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns: dict = {}
            for table in _joined(batches):
                s, node, copies, core = (table.column(c).to_numpy() for c in ("s", "node", "copies", "core"))
                x = rows_of(table.column("vec"), "<f4", self.dim)
                for t, rows, bucket, met in self._places(s, x, list(rounds), turns, True):
                    keys, blocks, pooled = self.large[t]
                    at, large = _found(keys, bucket)
                    many = np.where(large, blocks[at], 1) if len(keys) else np.ones(len(rows), np.int64)
                    first, own = np.zeros(len(rows), np.int64), np.where(large, pooled[at], 1) if len(keys) else many
                    groups, starts, owns = self.apart[t]
                    where, alone = _found(groups, self._both(bucket, met))
                    alone &= large & (met != 0)
                    if alone.any():
                        first[alone], own = starts[where[alone]], np.where(alone, owns[where], own)
                    block = first + (kernels.mix(node[rows].view(np.uint64)) % np.maximum(own, 1).astype(np.uint64)).astype(np.int64)
                    for r in rounds[t]:
                        other = (r - block) % many
                        take = np.flatnonzero((r < many) & ~(alone & (other >= first) & (other < first + own)))
                        if not len(take):
                            continue
                        b, w = block[take], other[take]
                        pair = (np.minimum(b, w) << 32) + np.maximum(b, w)
                        key = kernels.mix(bucket[take] ^ kernels.mix(pair.view(np.uint64)))
                        side = np.where(b == w, 2, np.where(b < w, 0, 1)).astype(np.int32)
                        order = np.lexsort((side, key))
                        key, side, take = key[order], side[order], take[order]
                        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
                        start = np.flatnonzero(edge)
                        start = np.flatnonzero(edge | (kernels.grouped_positions(np.diff(start, append=len(key))) % _RUN == 0))
                        n = np.diff(start, append=len(key))
                        of = rows[take]
                        columns = [kernels.binary_column(z, n) for z in (node[of], copies[of], core[of], met[take])]
                        yield pa.RecordBatch.from_arrays([pa.array(key[start].view(np.int64)), pa.array(side[start]), *columns, kernels.binary_column(x[of].ravel(), n * self.dim)], names=["key", "side", "node", "copies", "core", "met", "vec"])

        return work


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to about ``_TAKEN`` rows, so that a bucket's nodes go in few rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= _TAKEN:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def unpacked(table: pa.Table, dim: int) -> pa.Table:
    """A row for each node of ``PACKED`` rows."""
    values = {c: kernels.binary_values(table.column(c), kind)[0] for c, kind in (("node", "<i8"), ("copies", "<i4"), ("core", "<f4"), ("met", "<i8"))}
    n = np.diff(kernels.binary_values(table.column("node"), "<i8")[1])
    vec = kernels.binary_values(table.column("vec"), "<f4")[0]
    return pa.table({"side": np.repeat(table.column("side").to_numpy(), n), **values, "vec": kernels.binary_column(vec, np.full(len(values["node"]), dim))})
