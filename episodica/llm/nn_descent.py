"""Problem 5: the most similar vectors for every vector, by NN-descent.

The first neighbours come from cells: centres are fitted on a bounded sample of ``fit_rows`` vectors
(spherical k-means, about ``cell_rows`` vectors a cell), every vector has its home in the cell of its
nearest centre and is compared with the home rows of its ``probes`` nearest cells. Then rounds of
Spark joins bring every vector to its neighbours and reverse neighbours, where neighbours of
neighbours are compared and offered to each other, until at most ``delta`` of the list entries change
or, where it is given, ``rounds`` are done. Two records are compared only if one is new to the
other's list since the last round. Vectors travel as 16-bit fixed-point numbers, which carry a cosine
to about 1e-5. Probes and rounds are worked off in passes whose shuffle files are dropped, so that
not all of them lie on disk at once. Single queries walk the finished graph greedily (``search``).

With ``least`` only neighbours of at least that cosine are asked for, and lists hold no entry below
the cosine of twice that angle: two records within the angle of a common neighbour are at most that
far apart, so weaker entries lead to none that is asked for.

The result is approximate as stated by the problem; recall is measured in the tests. What is bounded
(lists of ``k`` + slack entries, ``fan`` neighbours offered a round, ``cell_cap`` home rows compared at
once) are the method's parameters: no vector is left out, and a cell above its cap is divided by
random planes through its centre in several ways, then by hash, not cut; the rounds make up for it.

Defined results: rows with a null id or without a usable vector have no neighbours; rows that repeat
an id are one record; equal similarities go by a hash of the id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import collect_garbage, durable, release, spread
from . import kernels
from .vectors import rows_of, unit_vectors

_LISTS = "node long, nbrs binary, sims binary, news binary"
#: Rows that meet in one pass of a round, passes of a round at most, and tables of offers held before they are merged.
_PASS_ROWS, _PASSES, _HELD = 1_000_000, 16, 4
#: Cosine error of the vectors that travel, with room to spare.
_NEAR = 1e-4


def _narrow(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 32767).astype("<i2")


def _wide(column: pa.Array, dim: int) -> np.ndarray:
    return rows_of(column, "<i2", dim).astype(np.float32) * np.float32(1 / 32767)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), np.int64)
    for k in range(0, len(x), 1024):
        c = x[k : k + 1024] @ centres.T
        near = np.argpartition(-c, n - 1, axis=1)[:, :n] if n < c.shape[1] else np.tile(np.arange(n), (len(c), 1))
        out[k : k + 1024] = np.take_along_axis(near, np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable"), 1)
    return out


def _centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means."""
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(10):
        total = np.zeros_like(centres)
        np.add.at(total, _nearest(x, centres, 1)[:, 0], x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        empty = size[:, 0] < 1e-6
        total[empty], size[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        centres = total / size
    return centres


class _Cells:
    """Centres of cells, and the planes that divide those with too many home rows in several ways."""

    turns = 4

    def __init__(self, x: np.ndarray, cells: int, seed: int):
        self.seed, self.planes = seed, {}
        self.centres = np.zeros((1, x.shape[1]), np.float32)
        if len(x):
            rng = np.random.default_rng(seed)
            self.centres = _centres(x, cells, rng)
            home, even = self.nearest(x, 1)[:, 0], len(x) / cells
            sizes = np.bincount(home, minlength=cells)
            # A cell with more than its share, as of a dense topic, gets centres of its own; at most as many again.
            parts = [self.centres[sizes <= 2 * even]] + [_centres(x[home == c], int(sizes[c] / even), rng) for c in np.flatnonzero(sizes > 2 * even)]
            self.centres = np.concatenate(parts)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return _nearest(x, self.centres, n)

    def divide(self, sizes: dict[int, int], cap: int) -> None:
        for cell, n in sizes.items():
            if n > cap:
                bits = int(np.ceil(np.log2(n / cap)))
                self.planes[cell] = np.random.default_rng([self.seed, cell]).standard_normal((self.turns, bits, self.centres.shape[1])).astype(np.float32)

    def buckets(self, x: np.ndarray, cell: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows to place at this turn, and a key for the part of ``cell`` in which each lies; undivided cells have one turn."""
        rows = np.arange(len(x)) if turn == 0 else np.flatnonzero(np.isin(cell, list(self.planes)))
        side = np.zeros(len(x), np.uint64)
        for c in set(np.unique(cell[rows]).tolist()) & self.planes.keys():
            at = np.flatnonzero(cell == c)
            bits = (x[at] - self.centres[c]) @ self.planes[c][turn].T > 0
            side[at] = (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64) * np.uint64(self.turns) + np.uint64(turn + 1)
        return rows, kernels.mix(kernels.mix(cell[rows].astype(np.uint64)) + side[rows]).view(np.int64)


def _packed(nbr: np.ndarray, sim: np.ndarray, new: np.ndarray, names: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), kernels.binary_column(nbr.astype("<i8"), counts), kernels.binary_column(sim.astype("<f4"), counts), kernels.binary_column(new.astype("u1"), counts)], names=["node", "nbrs", "sims", "news"])


def _lists(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, new: np.ndarray, keep: int) -> pa.RecordBatch:
    """The ``keep`` best distinct neighbours of each node as packed lists, nodes in order; an old entry stays old."""
    order = np.lexsort((new, nbr, node))
    node, nbr, sim, new = node[order], nbr[order], sim[order], new[order]
    one = np.ones(len(node), bool)
    one[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
    node, nbr, sim, new = node[one], nbr[one], sim[one], new[one]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim, new = node[order], nbr[order], sim[order], new[order]
    _, counts = np.unique(node, return_counts=True)
    top = kernels.grouped_positions(counts) < keep
    node, nbr, sim, new = node[top], nbr[top], sim[top], new[top]
    names, counts = np.unique(node, return_counts=True)
    return _packed(nbr, sim, new, names, counts)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nbr, offsets = kernels.binary_values(b.column("nbrs"), "<i8")
    sim, _ = kernels.binary_values(b.column("sims"), "<f4")
    new, _ = kernels.binary_values(b.column("news"), "u1")
    return np.repeat(b.column("node").to_numpy(), np.diff(offsets)), nbr, sim, new


def _aged(lists: DataFrame) -> DataFrame:
    """The lists with every entry marked as old."""

    def age(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, nbr, sim, new = _flat(b)
                yield _packed(nbr, sim, np.zeros_like(new), b.column("node").to_numpy(), np.diff(kernels.binary_values(b.column("nbrs"), "<i8")[1]))

    return lists.mapInArrow(age, _LISTS)


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """One list a node out of several; a node's rows arrive together and only its best entries are held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            parts = _flat(b)
            if held is not None:
                parts = tuple(np.concatenate(z) for z in zip(held, parts))
            done = _lists(*parts, keep)
            held = _flat(done.slice(done.num_rows - 1))
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
        if held is not None:
            yield _lists(*held, keep)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(merge, _LISTS)


class NeighbourGraph:
    def __init__(self, df: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, k: int = 10, slack: int = 10, least: float | None = None, cell_rows: int = 4096, cell_cap: int = 16384, probes: int = 8, fit_rows: int = 32768, fan: int = 12, rounds: int | None = None, delta: float = 0.001, seed: int = 5):
        self.dim, self.k, self.keep, self.cell_rows, self.cell_cap, self.probes, self.fit_rows = dim, k, k + slack, cell_rows, cell_cap, probes, fit_rows
        self.fan, self.rounds, self.delta, self.seed = fan, rounds, delta, seed
        self.least, self.floor = (-2.0, -2.0) if least is None else (least, 2 * least * least - 1 if least > 0 else -2.0)
        v = unit_vectors(spread(df.select(*{id_col, vector_col})), id_col=id_col, vector_col=vector_col, scope_col=None, dim=dim)
        self.vectors = durable(v.select(F.xxhash64(F.col("id").cast("string")).alias("node"), "id", "vec"), "vectors")
        self._cells: Broadcast | None = None
        self._graph: DataFrame | None = None

    def cells(self) -> Broadcast:
        """The cells, fitted on at most about ``fit_rows`` vectors chosen by hash; at least 16 of these a cell, so their number is bounded too."""
        if self._cells is None:
            dim, total = self.dim, self.vectors.count()
            every = max(1, -(-total // self.fit_rows))
            sample = self.vectors.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("vec").toArrow()
            x = rows_of(sample.column("vec"), "<f4", dim) if sample.num_rows else np.zeros((0, dim), np.float32)
            cells = _Cells(x, max(1, min(-(-total // self.cell_rows), len(x) // 16)), self.seed)
            shared = self.vectors.sparkSession.sparkContext.broadcast(cells)

            def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(shared.value.nearest(rows_of(b.column("vec"), "<f4", dim), 1)[:, 0])], names=["cell"])

            sizes = self.vectors.select("vec").mapInArrow(homes, "cell long").groupBy("cell").count()
            cells.divide({r["cell"]: r["count"] for r in sizes.collect()}, self.cell_cap)
            if cells.planes:
                shared = self.vectors.sparkSession.sparkContext.broadcast(cells)
            self._cells = shared
        return self._cells

    def _first_lists(self) -> DataFrame:
        lists = None
        for first in range(0, self.probes, 4):
            found = self._cell_lists(first, min(first + 4, self.probes))
            following = durable(_merged(found if lists is None else lists.union(found), self.keep), "neighbour-graph")
            if lists is not None:
                release(lists)
            lists = following
            del found
            collect_garbage(lists)
        return lists

    def _cell_lists(self, start: int, stop: int) -> DataFrame:
        """Lists from the home rows of every vector's nearest cells from the ``start``-th up to the ``stop``-th."""
        dim, keep, cap, floor, cells = self.dim, self.keep, self.cell_cap, self.floor, self.cells()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = rows_of(b.column("vec"), "<f4", dim)
                near = cells.value.nearest(x, stop)
                vec = kernels.binary_column(_narrow(x).ravel(), np.full(len(x), dim))
                for p in {0, *range(start, near.shape[1])}:
                    for turn in range(cells.value.turns):
                        rows, bucket = cells.value.buckets(x, near[:, p], turn)
                        if len(rows):
                            flags = np.full(len(rows), p == 0), np.full(len(rows), start <= p)
                            yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column("node").take(pa.array(rows)), *[pa.array(z) for z in flags], vec.take(pa.array(rows))], names=["bucket", "node", "home", "asks", "vec"])

        placed = self.vectors.select("node", "vec").mapInArrow(place, "bucket long, node long, home boolean, asks boolean, vec binary")
        if cells.value.planes:
            # Buckets that planes could not divide hold many equal or nearly equal vectors.
            full = durable(placed.where("home").groupBy("bucket").count().where(F.col("count") > cap).select("bucket", F.ceil(F.col("count") / cap).alias("parts")), "full-buckets")
            side = F.broadcast(full) if full.count() <= 100_000 else full
            placed = placed.join(side, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.coalesce("parts", F.lit(1)))).drop("parts")
        else:
            placed = placed.withColumn("part", F.lit(0))

        def compare(table: pa.Table) -> pa.Table:
            node, x = table.column("node").to_numpy(), _wide(table.column("vec"), dim)
            at = [np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("home", "asks")]
            home, asks = (z[np.unique(node[z], return_index=True)[1]] for z in at)
            names, counts, nbrs, sims = [], [], [], []
            if len(home):
                own = np.minimum(np.searchsorted(node[home], node[asks]), len(home) - 1)
                own = np.where(node[home][own] == node[asks], own, -1)
                to, width = x[home].T.copy(), min(keep, len(home))
                step = max(16, (1 << 20) // len(home))
                for k in range(0, len(asks), step):
                    c = x[asks[k : k + step]] @ to
                    o = own[k : k + step]
                    c[np.flatnonzero(o >= 0), o[o >= 0]] = -3
                    if floor > -2 and np.count_nonzero(c >= floor) <= 2 * keep * len(c):
                        r, j = np.nonzero(c >= floor)
                        order = np.lexsort((j, -c[r, j], r))
                        order = order[kernels.grouped_positions(np.bincount(r, minlength=len(c))) < keep]
                        r, j = r[order], j[order]
                    else:
                        j = np.argpartition(c, len(home) - width, axis=1)[:, len(home) - width :].ravel()
                        r = np.repeat(np.arange(len(c)), width)
                        ok = c[r, j] >= floor
                        r, j = r[ok], j[ok]
                    some, n = np.unique(r, return_counts=True)
                    names.append(node[asks[k + some]])
                    counts.append(n)
                    nbrs.append(node[home[j]])
                    sims.append(c[r, j])
            if not names:
                return pa.table({"node": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("nbrs", "sims", "news")}})
            names, counts, nbrs, sims = (np.concatenate(z) for z in (names, counts, nbrs, sims))
            return pa.Table.from_batches([_packed(nbrs, sims, np.ones(len(nbrs)), names, counts)])

        return placed.groupBy("bucket", "part").applyInArrow(compare, _LISTS)

    def _round(self, graph: DataFrame) -> list[DataFrame]:
        """Lists offered to nodes by their neighbours' neighbours, each better than the node's last entry."""
        dim, fan, keep, floor = self.dim, self.fan, self.keep, self.floor

        def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                node, nbr, sim, new = _flat(b)
                _, counts = np.unique(node, return_counts=True)
                near = kernels.grouped_positions(counts) < fan
                node, nbr, sim, new = node[near], nbr[near], sim[near], new[near]
                yield _lists(np.concatenate([node, nbr]), np.concatenate([nbr, node]), np.concatenate([sim, sim]), np.concatenate([new, new]), 2 * fan)

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    node, nbr, _, new = _flat(b)
                    # Where nothing is new, all have met before.
                    own = np.unique(node[new > 0])
                    at = np.isin(node, own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[at], own])), pa.array(np.concatenate([nbr[at], own])), pa.array(np.concatenate([new[at] > 0, np.zeros(len(own), bool)]))], names=["at", "node", "new"])

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    _, _, sim, _ = _flat(b)
                    n = np.diff(kernels.binary_values(b.column("nbrs"), "<i8")[1])
                    last = np.where(n < keep, np.float32(floor), sim[np.cumsum(n) - 1])
                    yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(last)], names=["node", "last"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches_and_end(batches):
                t = b if held is None else (pa.Table.from_batches([held]) if b is None else pa.concat_tables([pa.Table.from_batches([held]), pa.Table.from_batches([b])])).combine_chunks().to_batches()[0]
                held = None
                if t is None:
                    return
                at = t.column("at").to_numpy()
                if b is not None:
                    cut = int(np.searchsorted(at, at[-1]))
                    held, t, at = t.slice(cut), t.slice(0, cut), at[:cut]
                if not len(at):
                    continue
                x = _wide(t.column("vec"), dim)
                new = t.column("new").to_numpy(zero_copy_only=False)
                node, last = t.column("node").to_numpy(), t.column("last").to_numpy()
                _, start, count = np.unique(at, return_index=True, return_counts=True)
                got = []
                for m in np.unique(count):
                    if m < 2:
                        continue
                    for block in np.array_split(start[count == m], max(1, int((count == m).sum()) // 2000)):
                        rows = block[:, None] + np.arange(m)
                        y = x[rows]
                        c = y @ y.transpose(0, 2, 1)
                        better = (c > last[rows][:, :, None]) & (node[rows][:, :, None] != node[rows][:, None, :]) & (new[rows][:, :, None] | new[rows][:, None, :])
                        g, i, j = np.nonzero(better)
                        got.append((node[rows[g, i]], node[rows[g, j]], c[g, i, j]))
                if got:
                    u, v, c = (np.concatenate(z) for z in zip(*got))
                    yield _lists(u, v, c, np.ones(len(u), np.uint8), keep)

        sent = durable(_merged(graph.mapInArrow(both_ways, _LISTS), 2 * fan).mapInArrow(edges, "at long, node long, new boolean"), "sent-nodes")
        bound = graph.mapInArrow(least, "node long, last float")

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = rows_of(b.column("vec"), "<f4", dim)
                    yield pa.RecordBatch.from_arrays([b.column("node"), kernels.binary_column(_narrow(x).ravel(), np.full(len(x), dim))], names=["node", "vec"])

        moving = durable(self.vectors.select("node", "vec").mapInArrow(narrow, "node long, vec binary").dropDuplicates(["node"]).join(bound, "node"), "moving-vectors")
        passes = max(1, min(_PASSES, -(-sent.count() // _PASS_ROWS)))
        offered: list[DataFrame] = []
        for p in range(passes):
            if len(offered) == _HELD:
                every = offered[0]
                for o in offered[1:]:
                    every = every.union(o)
                held = durable(_merged(every, keep), "offered-neighbours")
                for o in offered:
                    release(o)
                offered = [held]
                del every, o
            here = sent.where(F.pmod(F.xxhash64("at", F.lit(1)), F.lit(passes)) == p)
            met = here.join(moving, "node").repartition("at").sortWithinPartitions("at").mapInArrow(meet, _LISTS)
            offered.append(durable(_merged(met, keep), "offered-neighbours"))
            del here, met
            collect_garbage(sent)
        release(sent)
        release(moving)
        return offered

    def _changed(self, graph: DataFrame) -> tuple[int, int]:
        """New entries among those asked for, and all of these."""
        k, least = self.k, self.least

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    node, _, sim, new = _flat(b)
                    _, counts = np.unique(node, return_counts=True)
                    asked = (kernels.grouped_positions(counts) < k) & (sim >= least - _NEAR)
                    yield pa.RecordBatch.from_arrays([pa.array([int(new[asked].sum())]), pa.array([int(asked.sum())])], names=["changed", "entries"])

        found = graph.mapInArrow(count, "changed long, entries long").agg(F.sum("changed"), F.sum("entries")).first()
        return found[0] or 0, found[1] or 0

    def graph(self) -> DataFrame:
        """(node, nbrs, sims, news): packed lists of the best neighbours, best first."""
        if self._graph is None:
            graph = self._first_lists()
            self.changes: list[int] = []
            while self.rounds is None or len(self.changes) < self.rounds:
                offered = self._round(graph)
                every = _aged(graph)
                for o in offered:
                    every = every.union(o)
                following = durable(_merged(every, self.keep), "neighbour-graph")
                for t in (graph, *offered):
                    release(t)
                graph = following
                del every, offered, t
                collect_garbage(graph)
                changed, entries = self._changed(graph)
                self.changes.append(changed)
                if changed <= self.delta * entries:
                    break
            self._graph = graph
        return self._graph

    def edges(self) -> DataFrame:
        """(a, b, sim): directed entries of the lists, with the similarity in single precision."""

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in _flat(b)[:3]], names=["a", "b", "sim"])

        return self.graph().mapInArrow(flat, "a long, b long, sim float")

    def exact_pairs(self, least: float) -> DataFrame:
        """(id_a, id_b, cosine): pairs where one is among the ``k`` nearest of the other and the exact cosine is >= ``least``."""
        dim = self.dim
        near = self.edges().where(F.col("sim") >= least - _NEAR)
        v = self.vectors
        a = v.select(F.col("node").alias("a"), F.col("id").alias("x"), F.col("vec").alias("va"))
        b = v.select(F.col("node").alias("b"), F.col("id").alias("y"), F.col("vec").alias("vb"))

        def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                if t.num_rows:
                    p, q = (rows_of(t.column(c), "<f4", dim).astype(np.float64) for c in ("va", "vb"))
                    c = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([t.column("x"), t.column("y"), pa.array(c)], names=["x", "y", "cosine"])

        kind = dict(v.dtypes)["id"]
        exact = near.join(a, "a").join(b, "b").select("x", "y", "va", "vb").mapInArrow(cosine, f"x {kind}, y {kind}, cosine double").dropDuplicates(["x", "y"])
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y")))
        return ranked.where((F.col("rank") <= self.k) & (F.col("cosine") >= least)).groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("cosine").alias("cosine"))

    def neighbours(self) -> DataFrame:
        """(id, neighbour_id, rank, similarity): the ``k`` nearest of every record."""
        ids = self.vectors.select("node", "id").distinct()
        ranked = self.edges().withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= self.k)
        return ranked.join(ids.select(F.col("node").alias("a"), "id"), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("neighbour_id")), "b").select("id", "neighbour_id", "rank", F.round("sim", 4).alias("similarity"))

    def search(self, queries: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", k: int = 10, beam: int = 80, starts: int = 10, cells_asked: int = 12, every: int = 16, steps: int = 8) -> DataFrame:
        """(query_id, id, similarity): greedy search of the graph for other vectors, all queries side by side.

        One row in ``every`` is an entry to the graph, as neighbour lists do not lead from topic to topic.
        Each query starts at the ``starts`` best entries of each of its ``cells_asked`` nearest cells. Each
        step joins the open entries of every query's beam to the graph, scores their neighbours and keeps
        the best ``beam``; it ends when no beam changes or after ``steps``.
        """
        dim, cells = self.dim, self.cells()
        q = unit_vectors(queries, id_col=id_col, vector_col=vector_col, scope_col=None, dim=dim).select(F.col("id").alias("query_id"), F.col("vec").alias("qv")).dropDuplicates(["query_id"])
        q = durable(q, "search-queries")
        kind = dict(q.dtypes)["query_id"]
        graph = self.edges().select(F.col("a").alias("node"), F.col("b").alias("next"))
        beam_w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "node")

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = cells.value.nearest(rows_of(b.column("vec"), "<f4", dim), 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("node"), b.column("vec")], names=["cell", "node", "vec"])

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = cells.value.nearest(rows_of(b.column("qv"), "<f4", dim), cells_asked)
                    row = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column("query_id").take(row), b.column("qv").take(row)], names=["cell", "query_id", "qv"])

        def begin(asks: pa.Table, entries: pa.Table) -> pa.Table:
            p, x, n = rows_of(asks.column("qv"), "<f4", dim), rows_of(entries.column("vec"), "<f4", dim), min(starts, entries.num_rows)
            rows, to = [], []
            for k in range(0, len(p) if n else 0, 1024):
                c = p[k : k + 1024] @ x.T
                to.append(np.argpartition(c, len(x) - n, axis=1)[:, len(x) - n :].ravel())
                rows.append(np.repeat(np.arange(k, k + len(c)), n))
            rows, to = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, to))
            return pa.table({"query_id": asks.column("query_id").take(pa.array(rows)), "node": entries.column("node").take(pa.array(to))})

        def scored(pairs: DataFrame) -> DataFrame:
            def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for t in batches:
                    if t.num_rows:
                        p, o = rows_of(t.column("qv"), "<f4", dim), rows_of(t.column("vec"), "<f4", dim)
                        yield pa.RecordBatch.from_arrays([t.column("query_id"), t.column("node"), pa.array((p * o).sum(axis=1))], names=["query_id", "node", "sim"])

            full = pairs.join(q, "query_id").join(self.vectors.select("node", "vec"), "node").select("query_id", "node", "qv", "vec")
            return full.mapInArrow(score, f"query_id {kind}, node long, sim float").dropDuplicates(["query_id", "node"])

        every = max(1, min(every, self.vectors.count() // 1024))
        entries = self.vectors.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(every)) == 0).select("node", "vec").mapInArrow(placed, "cell long, node long, vec binary")
        asks = q.mapInArrow(asked, f"cell long, query_id {kind}, qv binary")
        first = asks.groupBy("cell").cogroup(entries.groupBy("cell")).applyInArrow(lambda a, e: begin(a, e), f"query_id {kind}, node long")
        state = scored(first.distinct()).withColumn("open", F.lit(True))
        for _ in range(steps):
            state = durable(state.withColumn("r", F.row_number().over(beam_w)).where(F.col("r") <= beam).drop("r"), "search-beam")
            if state.where("open").isEmpty():
                break
            onward = state.where("open").join(graph, "node").select("query_id", F.col("next").alias("node")).distinct().join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
            state = state.withColumn("open", F.lit(False)).union(scored(onward).withColumn("open", F.lit(True)))
        ids = self.vectors.select("node", "id").distinct()
        return state.join(ids, "node").where("id <> query_id").withColumn("r", F.row_number().over(beam_w)).where(F.col("r") <= k).select("query_id", "id", F.round(F.col("sim").cast("double"), 6).alias("similarity"))


def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The non-empty batches, then None."""
    for b in batches:
        if b.num_rows:
            yield b
    yield None
