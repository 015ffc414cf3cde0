"""The condensed hierarchy against its definition read downwards, in one level and in many."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from episodica.llm.hierarchy import LEAST, condensed


def read_down(copies, edges, cut, min_size):
    """{node: (members of its kept cluster, persistence)} and {members: stability}."""
    weight = lambda part: sum(copies[n] for n in part)

    def components(nodes, links):
        left, parts = set(nodes), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                n = todo.pop()
                part.add(n)
                for a, b, _ in links:
                    for p, q in ((a, b), (b, a)):
                        if p == n and q in left:
                            left.discard(q)
                            todo.append(q)
            parts.append(frozenset(part))
        return parts

    def cluster(members, birth):
        leave, part, below = {}, members, []
        links = sorted((e for e in edges if e[0] in members and e[1] in members), key=lambda e: (e[2], min(e[:2]), max(e[:2])))
        while True:
            if len(part) == 1:
                leave |= {n: 1 / LEAST for n in part}
                break
            a, b, w = links.pop()
            inside = [e for e in links if e[0] in part and e[1] in part]
            if a not in part:
                continue
            d = 1 / max(w, LEAST)
            one, two = components(part, inside)
            big = [p for p in (one, two) if weight(p) >= min_size]
            if len(big) == 1:
                leave |= {n: d for n in part - big[0]}
                part = big[0]
                continue
            leave |= {n: d for n in part}
            below = [cluster(p, d) for p in big]
            break
        own = sum(copies[n] * (leave[n] - birth) for n in members)
        offer = sum(b[0] for b in below)
        if own >= offer:
            return own, {n: (members, leave[n]) for n in members}, {members: own}
        return offer, {k: v for b in below for k, v in b[1].items()}, {k: v for b in below for k, v in b[2].items()}

    kept, stability = {}, {}
    for part in components(copies, edges):
        if weight(part) >= min_size:
            _, k, s = cluster(part, 1 / cut)
            kept |= k
            stability |= s
    return kept, stability


@pytest.mark.parametrize("ties", [False, True])
def test_condensed(spark, ties):
    rng = np.random.default_rng(17)
    n = 120
    names = rng.permutation(10_000)[:n].astype(int).tolist()
    copies = dict(zip(names, np.where(rng.random(n) < 0.9, 1, 6).tolist()))
    w = rng.integers(1, 6, n) / 40 if ties else rng.random(n) * 0.2
    edges = [(names[i], names[int(rng.integers(max(0, i - 9), i))], float(w[i])) for i in range(1, n) if i % 41]
    tree = spark.createDataFrame(pd.DataFrame(edges, columns=["a", "b", "w"]))
    group = {m: m for m in names}
    for a, b, _ in edges:
        old, new = group[a], group[b]
        group = {m: new if g == old else g for m, g in group.items()}
    joined = {m for a, b, _ in edges for m in (a, b)}
    labels = spark.createDataFrame([(m, g) for m, g in group.items() if m in joined], "node long, comp long")
    counts = spark.createDataFrame(list(copies.items()), "node long, copies long")
    want, stable = read_down(copies, edges, 0.2, 5)
    for at_once in (1_000_000, 60):
        chosen, stability = condensed(tree, labels, counts, 0.2, 5, at_once)
        rows = chosen.toPandas()
        members = {c: frozenset(g) for c, g in rows.groupby("cluster").node.apply(list).items()}
        assert {r.node: (members[r.cluster], r.persistence) for r in rows.itertuples()} == {k: (m, pytest.approx(p, abs=1e-5)) for k, (m, p) in want.items()}
        assert {members[r.cluster]: r.stability for r in stability.collect()} == {m: pytest.approx(s, rel=1e-6, abs=1e-4) for m, s in stable.items()}
