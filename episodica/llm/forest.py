"""Spanning forests: one in arrays for a block of edges, one by distributed Boruvka rounds for a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import durable, release


def local_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the edges of a minimum spanning forest over n nodes, and each node's component; ties go by the nodes' ids.

    The minimum forest of a whole graph lies within the union of its blocks' forests, so a block
    sends at most n - 1 edges however dense it is.
    """
    order = np.lexsort((np.maximum(ids[u], ids[v]), np.minimum(ids[u], ids[v]), w))
    su, sv = u[order], v[order]
    live, comp, chosen = np.arange(len(order)), np.arange(n), []
    while len(live):
        cu, cv = comp[su[live]], comp[sv[live]]
        differ = cu != cv
        live, cu, cv = live[differ], cu[differ], cv[differ]
        if not len(live):
            break
        none = len(order)
        best = np.full(n, none)
        other = np.full(n, none)
        best[cu[::-1]] = live[::-1]
        other[cv[::-1]] = live[::-1]
        best = np.minimum(best, other)
        roots = np.flatnonzero(best < none)
        picked = best[roots]
        chosen.append(np.unique(picked))
        parent = np.arange(n)
        a, b = comp[su[picked]], comp[sv[picked]]
        parent[roots] = np.where(a == roots, b, a)
        mutual = (parent[parent[roots]] == roots) & (roots < parent[roots])
        parent[roots[mutual]] = roots[mutual]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp = parent[comp]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64), comp


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of ``edges`` (a, b, w) and the component of each of its nodes.

    Each round every component takes its lightest outgoing edge (ties by the nodes, so no cycle can
    arise), the choices are followed to a root by pointer doubling, and the edges that are left are
    relabelled, with the lightest of parallel ones kept. Components at least halve in each round.
    """
    live = durable(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b").where("a <> b"), "boruvka-edges")
    labels = durable(live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node")), "boruvka-labels")
    tree = None
    while not live.isEmpty():
        least = F.min(F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o")).alias("m")
        outward = live.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "w", "a", "b").union(live.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "w", "a", "b"))
        best = durable(outward.groupBy("c").agg(least).select("c", F.col("m.o").alias("p"), "m.w", "m.a", "m.b"), "boruvka-best")
        picked = best.select("a", "b", "w").distinct()
        tree = picked if tree is None else tree.union(picked)
        up = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hooks = best.select("c", "p").join(up, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        hooks = durable(hooks, "boruvka-hooks")
        while True:
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = durable(hooks.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "boruvka-hooks")
            moved = not jumped.where("moved").isEmpty()
            release(hooks)
            hooks = jumped
            if not moved:
                break
        hooks = hooks.select("c", "p")
        to_a, to_b = hooks.select(F.col("c").alias("ca"), F.col("p").alias("pa")), hooks.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
        left = live.join(to_a, "ca").join(to_b, "cb").where("pa <> pb").select(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb"), "w", "a", "b")
        left = left.groupBy("ca", "cb").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("ca", "cb", "m.w", "m.a", "m.b")
        next_live = durable(left, "boruvka-edges")
        next_labels = durable(labels.join(hooks.select(F.col("c").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "boruvka-labels")
        release(live)
        release(labels)
        release(jumped)
        live, labels = next_live, next_labels
    if tree is None:
        tree = live.select("a", "b", "w")
    return tree, labels
