"""Problem 3: clusters of mutually similar records, by hierarchical density clustering.

Stages: (1) equal vectors of a scope are one node with a count; (2) a neighbour graph of all pairs
of nodes of a scope with cosine >= ``min_cosine``, found in blocks: a scope of up to
``bucket_rows`` nodes is one bucket, a larger one is divided by cross-polytope hashes into buckets
of about that size, in as many tables as keep the chance of missing a link at the threshold below
``miss``; a bucket is compared in square blocks of ``block_rows``, and the tables and block pairs are worked
off in waves, so that no more than about two copies of the vectors are on their way at once; (3) each block sends only its own
minimum spanning forest under the mutual-reachability distance, thinned as strips of rows come in, so
that a dense block neither emits its pairs nor holds more of them than a few strips have;
(4) distributed Boruvka rounds join the blocks' forests into one minimum spanning forest;
(5) the forest cut at 1 - min_cosine gives the single-linkage clusters, and condensing it gives the
density hierarchy, from which the most stable clusters are selected.

With ``min_samples`` 1 the core distance is 0 and the mutual-reachability distance is the plain one.

Defined results: rows with a null id or scope or without a usable vector belong to no cluster; rows
that repeat an id are one record; ties go by node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import collect_garbage, durable, release, spread
from . import kernels
from .forest import boruvka, local_forest
from .hierarchy import condensed
from .layout import PACKED, Layout, unpacked
from .vectors import rows_of, unit_vectors

#: Rows of a strip, and links that a strip yields at once at most.
_STRIP, _LINKS = 1024, 1 << 20
#: Rows that a wave may always have, so that small tables take few waves.
_WAVE_ROWS = 200_000


def _similar(table: pa.Table, dim: int, cos: float, least: Callable[[np.ndarray, np.ndarray], np.ndarray | float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (row, column, cosine) of a block pair, strip by strip; each pair once. ``least`` gives the cosine,
    from ``cos`` on, below which pairs of the given rows and columns are of no use any more. Within a block, nodes with
    the same ``met`` other than 0 are not compared."""
    x = rows_of(table.column("vec"), "<f4", dim)
    side = table.column("side").to_numpy()
    whole = bool((side == 2).any())
    if whole:
        met = table.column("met").to_numpy() if "met" in table.column_names else np.zeros(len(x), np.int64)
        left = right = np.argsort(met, kind="stable")
        begin = np.flatnonzero(np.diff(met[left], prepend=met[left[0]] - 1)).tolist()
        parts = [(i, j, met[left[i]] == 0) for i, j in zip(begin, [*begin[1:], len(x)])]
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parts = [(0, len(left), False)]
    step = max(1, min(_STRIP, _LINKS // max(1, len(right))))
    for k, stop, inside in ((k, j, inside) for i, j, inside in parts for k in range(i, j, step)):
        at = left[k : min(k + step, stop)]
        past = (k if inside else stop) if whole else 0
        to = right[past:]
        c = x[at] @ x[to].T
        low = cos if least is None else least(at, to)
        hit = np.flatnonzero(c >= low - np.float32(1e-5))
        r, q = np.divmod(hit, max(1, len(to)))
        near = c.ravel()[hit].astype(np.float64)
        if inside:
            up = r < q
            r, q, near = r[up], q[up], near[up]
        r, q = at[r], to[q]
        edge = np.flatnonzero(near < cos + 1e-5)
        if len(edge):
            p, o = x[r[edge]].astype(np.float64), x[q[edge]].astype(np.float64)
            near[edge] = (p * o).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (o * o).sum(axis=1))
        # float32 vectors carry the cosine to about 1e-7.
        ok = near >= cos - 1e-7
        yield r[ok], q[ok], near[ok]


def _gathered(strips: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Strips joined until they have about ``_LINKS`` links."""
    held, size = [], 0
    for strip in strips:
        held.append(strip)
        size += len(strip[0])
        if size >= _LINKS:
            yield tuple(np.concatenate(z) for z in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held))


def nearest(table: pa.Table, dim: int, cos: float, k: int) -> pa.Table:
    """The ``k`` nearest other nodes of each node of a block pair; only these are held from strip to strip."""
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    u, v, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    low = np.full(len(node), cos, np.float32)

    def least(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        # Of use to one of the two, whose k-th nearest so far is farther.
        return np.minimum(low[at][:, None], low[to][None, :])

    for r, q, near in _gathered(_similar(table, dim, cos, least)):
        u, v, c = np.concatenate([u, r, q]), np.concatenate([v, q, r]), np.concatenate([c, near, near])
        order = np.lexsort((node[v], -c, u))
        u, v, c = u[order], v[order], c[order]
        at = kernels.grouped_positions(np.bincount(u, minlength=len(node)))
        low[u[at == k - 1]] = c[at == k - 1]
        u, v, c = u[at < k], v[at < k], c[at < k]
    return pa.table({"node": pa.array(node[u]), "other": pa.array(node[v]), "copies": pa.array(copies[v].astype(np.int32)), "distance": pa.array((1 - c).astype(np.float32))})


def thinned(table: pa.Table, dim: int, cos: float) -> pa.Table:
    """The minimum spanning forest of a block pair; at most n - 1 edges are held from strip to strip."""
    node = table.column("node").to_numpy()
    core = table.column("core").to_numpy()
    u, v, w = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    comp, most = np.arange(len(node)), np.full(len(node), -1.0)
    main, light = np.zeros(len(node), bool), cos

    def least(at: np.ndarray, to: np.ndarray) -> np.ndarray | float:
        # Within the largest component only links no heavier than its heaviest edge are of use.
        one, two = main[at], main[to]
        return np.where(one[:, None] & two[None, :], np.float32(light), np.float32(cos)) if light > cos and one.any() and two.any() else cos

    def lighter(strips: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
        for r, q, c in strips:
            far = np.maximum(np.maximum(core[r], core[q]), 1 - c)
            # A link inside a component is of use only if it is no heavier than the component's heaviest edge.
            ok = (far <= 1 - cos + 2e-7) & ((comp[r] != comp[q]) | (far <= most[comp[r]]))
            yield r[ok], q[ok], far[ok]

    for r, q, far in _gathered(lighter(_similar(table, dim, cos, least))):
        u, v, w = np.concatenate([u, r]), np.concatenate([v, q]), np.concatenate([w, far])
        keep, comp = local_forest(u, v, w, len(node), node)
        u, v, w = u[keep], v[keep], w[keep]
        most = np.full(len(node), -1.0)
        np.maximum.at(most, comp[u], w)
        largest = int(np.bincount(comp).argmax())
        main, light = comp == largest, 1 - float(most[largest])
    return pa.table({"a": pa.array(node[u]), "b": pa.array(node[v]), "w": pa.array(np.maximum(w, 0).astype(np.float64))})


class DensityClusters:
    def __init__(self, df: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", scope_col: str | None = "group_id", dim: int = 64, min_cosine: float = 0.80, min_size: int = 5, min_samples: int = 1, bucket_rows: int = 32768, block_rows: int = 16384, miss: float = 0.001, seed: int = 11):
        self.dim, self.cos, self.min_size, self.min_samples = dim, min_cosine, min_size, min_samples
        self.bucket_rows, self.block_rows, self.miss, self.seed = bucket_rows, block_rows, miss, seed
        vectors = unit_vectors(spread(df.select(*{id_col, vector_col, *([scope_col] if scope_col else [])})), id_col=id_col, vector_col=vector_col, scope_col=scope_col, dim=dim)
        vectors = durable(vectors, "unit-vectors")
        self.members = durable(vectors.select("id", "node").distinct(), "members")
        folded = vectors.groupBy(F.xxhash64("scope").alias("s"), "node").agg(F.first("vec").alias("vec"), F.countDistinct("id").cast("int").alias("copies"))
        self.nodes = durable(folded.select("s", "node", "copies", F.lit(0.0).cast("float").alias("core"), "vec"), "nodes")
        del folded
        release(vectors)
        collect_garbage(self.nodes)
        self._core: DataFrame | None = None
        self._tree: tuple[DataFrame, DataFrame] | None = None
        self._layout: Layout | None = None

    def layout(self) -> Layout:
        if self._layout is None:
            sizes = self.nodes.groupBy("s").count()
            # At most one scope for each block_rows nodes.
            scopes = {r.s: r["count"] for r in sizes.where(F.col("count") > self.block_rows).collect()}
            rows = self.nodes.count()
            plan = Layout(scopes, rows, dim=self.dim, cos=self.cos, bucket_rows=self.bucket_rows, block_rows=self.block_rows, miss=self.miss, seed=self.seed)
            for tables in ([0], list(range(1, plan.tables))):
                if not scopes or not tables:
                    continue
                found = self.nodes.select("s", "vec").mapInArrow(plan.counted(tables), "t int, bucket long, met long, n long")
                found = durable(found.groupBy("t", "bucket", "met").agg(F.sum("n").alias("n")), "bucket-sizes")
                # Of these, too, there is at most one for each block_rows nodes and table.
                large = found.groupBy("t", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > self.block_rows).collect()
                apart = found.where((F.col("met") != 0) & (F.col("n") > self.block_rows)).collect()
                plan.divide([(r.t, r.bucket, r.n) for r in large], [(r.t, r.bucket, r.met, r.n) for r in apart])
                release(found)
            self._layout = plan
        return self._layout

    def _compared(self, nodes: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> Iterator[DataFrame]:
        """What ``work`` gives for the block pairs of each wave, as durable tables."""
        plan, dim = self.layout(), self.dim
        for units in plan.waves(max(2 * plan.rows, _WAVE_ROWS)):
            pairs = nodes.mapInArrow(plan.dealt(units), PACKED)
            yield durable(pairs.groupBy("key").applyInArrow(lambda t: work(unpacked(t, dim)), schema), "wave")
            del pairs
            collect_garbage(nodes)

    def core_distances(self) -> DataFrame | None:
        """(node, core): distance to the ``min_samples``-th nearest record, itself counted; nodes without so many are left out."""
        k, dim, cos = self.min_samples, self.dim, self.cos
        if k <= 1:
            return None

        own = self.nodes.select("node", F.col("node").alias("other"), "copies", F.lit(0.0).cast("float").alias("distance"))
        near = Window.partitionBy("node").orderBy("distance", "other")
        best = None
        for found in self._compared(self.nodes, lambda t: nearest(t, dim, cos, k), "node long, other long, copies int, distance float"):
            # At most min_samples neighbours a node and block pair arrive here, so the windows are short.
            both = (found if best is None else found.union(best)).groupBy("node", "other").agg(F.first("copies").alias("copies"), F.min("distance").alias("distance"))
            last, best = best, durable(both.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r"), "nearest")
            release(found)
            if last is not None:
                release(last)
        seen = F.sum("copies").over(near.rowsBetween(Window.unboundedPreceding, 0))
        every = own if best is None else best.union(own)
        return every.withColumn("seen", seen).where(F.col("seen") >= k).groupBy("node").agg(F.min("distance").alias("core"))

    def forest(self) -> tuple[DataFrame, DataFrame]:
        """The minimum spanning forest (a, b, w) under mutual reachability, and (node, comp)."""
        if self._tree is None:
            dim, cos = self.dim, self.cos

            core = self.core_distances()
            self._core = durable(core, "core-distances") if core is not None else None
            nodes = self.nodes if self._core is None else durable(self.nodes.drop("core").join(self._core, "node").select("s", "node", "copies", "core", "vec"), "core-nodes")
            waves = list(self._compared(nodes, lambda t: thinned(t, dim, cos), "a long, b long, w double"))
            if nodes is not self.nodes:
                release(nodes)
            tree, labels = boruvka(reduce(DataFrame.union, waves))
            for wave in waves:
                release(wave)
            self._tree = durable(tree, "spanning-forest"), labels
        return self._tree

    def linked(self) -> DataFrame:
        """(id, cluster_key): single-linkage clusters of at least ``min_size`` records, keyed by their smallest id."""
        _, labels = self.forest()
        placed = self.members.join(labels, "node", "left").select("id", F.coalesce("comp", "node").alias("comp"))
        keys = placed.groupBy("comp").agg(F.min("id").alias("cluster_key"), F.count("*").alias("size")).where(F.col("size") >= self.min_size)
        return placed.join(keys, "comp").select("id", "cluster_key")

    def clusters(self, exemplars: int = 3, at_once: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
        """The most stable clusters of the condensed hierarchy: (id, cluster_key, persistence) of their members, and
        (cluster_key, size, stability, exemplars) with the ids of the most persistent members; ties go by core
        distance, then by id."""
        tree, labels = self.forest()
        counts = self.nodes.select("node", F.col("copies").cast("long").alias("copies"))
        chosen, stability = condensed(tree, labels, counts, 1 - self.cos, self.min_size, at_once)
        if self._core is not None:
            chosen = chosen.join(self._core, "node", "left")
        else:
            chosen = chosen.withColumn("core", F.lit(0.0))
        placed = durable(self.members.join(chosen, "node").select("id", "cluster", "persistence", "core"), "cluster-members")
        keys = placed.groupBy("cluster").agg(F.min("id").alias("cluster_key"), F.count("*").alias("size"))
        # The best few of each cluster, found by partial aggregates a cluster and part, so that no cluster meets in one task.
        order = F.struct((-F.col("persistence")).alias("p"), F.col("core").alias("d"), "id")
        part = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
        few = part.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "part").orderBy(order))).where(F.col("r") <= exemplars)
        best = few.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(order)), 1, exemplars).alias("z")).select("cluster", F.array_join(F.transform("z", lambda x: x["id"].cast("string")), ",").alias("exemplars"))
        described = keys.join(stability, "cluster").join(best, "cluster")
        return placed.join(keys, "cluster").select("id", "cluster_key", "persistence"), described.select("cluster_key", "size", "stability", "exemplars")
