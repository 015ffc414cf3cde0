"""The condensed density hierarchy of a spanning forest, from the forest's own edge weights.

Edges are added by growing weight w, that is by falling density 1 / w. A component of ``min_size``
records or more is a cluster; a smaller one is part of none. Where two clusters meet they end and a
new one that holds both begins; a smaller component that meets a cluster joins it, and smaller ones
that reach ``min_size`` together begin one. Read downwards, this is the condensed hierarchy: a cluster
loses members at the densities at which they joined and splits where its two clusters met. Stability
is the sum over members of the density at which they leave less the density at which the cluster
begins. A cluster is chosen if it is at least as stable as the best choice among its descendants, and
kept if none of its ancestors is chosen.

Components of up to ``at_once`` nodes are worked off many together in one task. For larger ones the
edges are divided by weight into levels of about that many edges; what the edges of a level join is,
again, worked off component by component, first upwards with each component's open cluster handed to
the level above, then downwards with what is kept. The result is the same.

Weights under ``LEAST``, which vectors in single precision cannot tell from 0, count as ``LEAST``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import durable
from . import kernels
from .forest import boruvka

LEAST = 1e-6

_STATE = "c long, size long, cluster long, total double, offer double"
_KEPT = "c long, kept long, birth double, density double"


class _Walk:
    """Edges added one by one over nodes that are components of lighter edges, some with an open cluster."""

    def __init__(self, nodes: pa.Table, edges: pa.Table, min_size: int):
        self.c = nodes.column("c").to_numpy()
        by_name = np.argsort(self.c)
        n = len(self.c)
        self.size = nodes.column("size").to_numpy().tolist()
        # Clusters: name, sum of its members' densities, best of its descendants, cluster above, density at its end, chosen.
        self.name: list[int] = []
        self.total: list[float] = []
        self.offer: list[float] = []
        self.above: list[int] = []
        self.end: list[float] = []
        self.chosen: list[bool] = []
        self.open = [-1] * n
        self.joined = [(-1, 0.0)] * n
        opened = nodes.column("cluster").to_pylist()
        total, offer = nodes.column("total").to_pylist(), nodes.column("offer").to_pylist()
        for i, name in enumerate(opened):
            if name is not None:
                self.open[i] = self._begin(name, total[i], offer[i])
        self.entered = list(self.open)
        self.parent = list(range(n))
        self.few: list[list[int]] = [[i] if self.open[i] < 0 else [] for i in range(n)]
        a, b, w = (edges.column(z).to_numpy() for z in ("a", "b", "w"))
        x, y = (by_name[np.searchsorted(self.c, edges.column(z).to_numpy(), sorter=by_name)] if len(a) else a for z in ("x", "y"))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a, w))
        with np.errstate(over="ignore"):
            names = kernels.mix(kernels.mix(a.astype(np.uint64)) + b.astype(np.uint64)).view(np.int64)
        density = 1 / np.maximum(w, LEAST)
        for i, j, d, name in zip(x[order].tolist(), y[order].tolist(), density[order].tolist(), names[order].tolist()):
            self._join(self.root(i), self.root(j), d, name, min_size)

    def _begin(self, name: int, total: float, offer: float) -> int:
        self.name.append(name)
        self.total.append(total)
        self.offer.append(offer)
        self.above.append(-1)
        self.end.append(0.0)
        self.chosen.append(False)
        return len(self.name) - 1

    def finish(self, cluster: int, size: int, density: float) -> float:
        """End a cluster and return the best that it and its descendants offer."""
        own = self.total[cluster] - size * density
        self.end[cluster] = density
        self.chosen[cluster] = own >= self.offer[cluster]
        return max(own, self.offer[cluster])

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def _join(self, i: int, j: int, density: float, name: int, min_size: int) -> None:
        if i == j:
            return
        if self.size[i] < self.size[j]:
            i, j = j, i
        p, q = self.open[i], self.open[j]
        both = self.size[i] + self.size[j]
        if p >= 0 and q >= 0:
            offer = self.finish(p, self.size[i], density) + self.finish(q, self.size[j], density)
            self.open[i] = self.above[p] = self.above[q] = self._begin(name, both * density, offer)
        elif p >= 0:
            self.total[p] += self.size[j] * density
            for k in self.few[j]:
                self.joined[k] = (p, density)
        else:
            self.few[i] += self.few[j]
            if both >= min_size:
                self.open[i] = self._begin(name, both * density, 0.0)
                for k in self.few[i]:
                    self.joined[k] = (self.open[i], density)
                self.few[i] = []
        self.few[j] = []
        self.parent[j] = i
        self.size[i] = both

    def state(self, of: np.ndarray) -> pa.Table:
        """Each component with its open cluster, under the name that ``of`` has for its nodes."""
        at = [i for i in range(len(self.parent)) if self.parent[i] == i]
        some = [self.open[i] for i in at]
        pick = lambda z, none: pa.array([z[k] if k >= 0 else none for k in some])
        return pa.table({"c": pa.array(of[at]), "size": pa.array([self.size[i] for i in at], pa.int64()), "cluster": pick(self.name, None).cast(pa.int64()), "total": pick(self.total, 0.0).cast(pa.float64()), "offer": pick(self.offer, 0.0).cast(pa.float64())})

    def kept(self, handed: list[tuple[int | None, float | None, float | None]] | None, lowest: float) -> pa.Table:
        """For each node the cluster that keeps it, with the density at which that begins and the one at which the node
        leaves it, null for the node's own open cluster. ``handed`` has the same for the component of each node; without
        it, open clusters end at the density ``lowest``."""
        roots = [self.root(i) for i in range(len(self.parent))]
        at: list[tuple[int | None, float | None, float | None]] = [(None, None, None)] * len(self.name)
        for i, r in enumerate(roots):
            if i == r and self.open[r] >= 0:
                k = self.open[r]
                if handed is not None:
                    at[k] = handed[i]
                else:
                    self.finish(k, self.size[r], lowest)
                    at[k] = (self.name[k], lowest, None) if self.chosen[k] else (None, None, None)
        for k in range(len(self.name) - 1, -1, -1):
            if self.above[k] >= 0:
                name, birth, density = at[self.above[k]]
                if name is not None:
                    at[k] = (name, birth, self.end[k] if density is None else density)
                elif self.chosen[k]:
                    at[k] = (self.name[k], self.end[k], None)
        out = []
        for i, r in enumerate(roots):
            if self.entered[i] >= 0:
                out.append(at[self.entered[i]])
            elif self.joined[i][0] >= 0:
                name, birth, density = at[self.joined[i][0]]
                out.append((name, birth, (self.joined[i][1] if density is None else density) if name is not None else None))
            else:
                out.append(handed[i] if handed is not None else (None, None, None))
        kept, birth, density = zip(*out) if out else ((), (), ())
        return pa.table({"c": pa.array(self.c), "kept": pa.array(kept, pa.int64()), "birth": pa.array(birth, pa.float64()), "density": pa.array(density, pa.float64())})


def condensed(tree: DataFrame, labels: DataFrame, counts: DataFrame, cut: float, min_size: int, at_once: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(node, cluster, persistence) of nodes in kept clusters, and (cluster, stability).

    ``tree`` is the forest (a, b, w), ``labels`` the component of each of its nodes, ``counts`` has the
    number of records (``copies``) of every node. Persistence is the density at which a node leaves its cluster.
    """
    nodes = counts.select("node", F.col("copies").cast("long").alias("copies")).join(labels, "node", "left").select("node", "copies", F.coalesce("comp", "node").alias("comp"))
    big = nodes.groupBy("comp").agg(F.sum("copies").alias("records"), F.count("*").alias("nodes")).where(F.col("records") >= min_size)
    place = durable(nodes.join(big.select("comp", "nodes"), "comp").select("node", "copies", "comp", "nodes", F.col("node").alias("c0")), "level-0")
    rows, widest = place.agg(F.count("*"), F.max("nodes")).first()
    levels = max(1, -(-(widest or 0) // at_once))
    edges = tree.join(place.select(F.col("node").alias("a"), "comp", "nodes"), "a")
    bounds = edges.where(F.col("nodes") > at_once).approxQuantile("w", [k / levels for k in range(1, levels)], 0.0001) if levels > 1 else []
    bounds = [-1.0, *bounds, 3.0]
    parts = max(1, -(-(rows or 0) // 100_000))

    opened = F.col("copies") >= min_size
    state = place.select(F.col("node").alias("c"), F.col("copies").alias("size"), F.when(opened, F.col("node")).alias("cluster"), F.when(opened, F.col("copies") / F.lit(LEAST)).otherwise(0.0).alias("total"), F.lit(0.0).alias("offer"))
    steps = []
    for k in range(1, levels + 1):
        here = edges.where((F.col("w") > bounds[k - 1]) & (F.col("w") <= bounds[k])).select("a", "b", "w", "comp")
        if levels > 1:
            here = here.join(place.select(F.col("node").alias("a"), F.col(f"c{k - 1}").alias("x")), "a").join(place.select(F.col("node").alias("b"), F.col(f"c{k - 1}").alias("y")), "b")
        else:
            here = here.select("*", F.col("a").alias("x"), F.col("b").alias("y"))
        if k < levels:
            _, joined = boruvka(here.select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
            up = joined.select(F.col("node").alias(f"c{k - 1}"), F.col("comp").alias(f"c{k}"))
            place = durable(place.join(up, f"c{k - 1}", "left").withColumn(f"c{k}", F.coalesce(f"c{k}", f"c{k - 1}")), f"level-{k}")
            here = durable(here.join(up.select(F.col(f"c{k - 1}").alias("x"), F.col(f"c{k}").alias("up")), "x").select("a", "b", "w", "x", "y", "up"), f"level-edges-{k}")
            state = durable(state.join(place.select(F.col(f"c{k - 1}").alias("c"), F.col(f"c{k}").alias("up")).distinct(), "c"), f"level-state-{k}")
        else:
            here = here.withColumnRenamed("comp", "up").select("a", "b", "w", "x", "y", "up")
            state = state.join(place.select(F.col(f"c{k - 1}").alias("c"), F.col("comp").alias("up")).distinct(), "c")
        steps.append((here, state))
        if k < levels:
            state = durable(_together(state, here, parts, lambda n, e: _Walk(n, e, min_size).state(n.column("up").to_numpy()), _STATE), f"level-open-{k}")
    lowest = 1 / cut
    kept = None
    for here, state in reversed(steps):
        if kept is None:
            found = _together(state, here, parts, lambda n, e: _Walk(n, e, min_size).kept(None, lowest), _KEPT)
        else:
            handed = state.join(kept.withColumnRenamed("c", "up"), "up")
            found = _together(handed, here, parts, lambda n, e: _Walk(n, e, min_size).kept(list(zip(*(n.column(z).to_pylist() for z in ("kept", "birth", "density")))), lowest), _KEPT)
        kept = durable(found, "level-kept")
    # A node that is a cluster by its copies alone leaves it at the highest density.
    final = kept.where("kept is not null").select(F.col("c").alias("node"), F.col("kept").alias("cluster"), "birth", F.coalesce("density", F.lit(1 / LEAST)).alias("density"))
    stability = final.join(place.select("node", "copies"), "node").groupBy("cluster").agg(F.round(F.sum(F.col("copies") * (F.col("density") - F.col("birth"))), 6).alias("stability"))
    return final.select("node", "cluster", F.round("density", 6).alias("persistence")), stability


def _together(nodes: DataFrame, edges: DataFrame, parts: int, work, schema: str) -> DataFrame:
    """``work`` on the nodes and edges of whole components, many components at a time."""
    bucket = F.pmod(F.xxhash64("up"), F.lit(parts)).alias("bucket")
    return nodes.select("*", bucket).groupBy("bucket").cogroup(edges.select("*", bucket).groupBy("bucket")).applyInArrow(lambda n, e: work(n, e), schema)
