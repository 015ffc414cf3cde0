"""The pN_found queries against brute force or SQL on the small tables."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import same

from episodica.llm import queries as q


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def pairs(df, a, b):
    rows = [(r[a], r[b]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, small, name):
    assert same(q.queries()[name](spark, small), small, q.oracle_sql()[name]) == ""


def test_p1(spark, small, table_of):
    e = table_of("episodes").drop_duplicates("id")
    sets, groups = {}, defaultdict(list)
    for i, g, t in zip(e.id, e.group_id, e.content):
        w = words(t)
        if g is not None and len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            groups[g].append(i)
    true = {(min(a, b), max(a, b)) for ids in groups.values() for a, b in itertools.combinations(ids, 2) if len(sets[a] & sets[b]) * 10 >= 6 * len(sets[a] | sets[b])}
    assert pairs(q.p1_found(spark, small), "id_a", "id_b") == true


def usable(e):
    ok = [x is not None and len(x) == 64 and np.isfinite(x).all() and (np.asarray(x) != 0).any() for x in e.embedding]
    e = e[ok]
    x = np.stack(e.embedding.values).astype(float)
    return e, x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("params", [{}, {"bucket_rows": 16, "block_rows": 8, "miss": 1e-6}])
def test_p3(spark, small, table_of, params):
    from episodica.llm.density import DensityClusters

    e, x = usable(table_of("episodes").drop_duplicates("id"))
    true = set()
    for g in set(e.group_id.dropna()):
        at = np.flatnonzero(e.group_id.values == g)
        root = {i: i for i in at}
        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in itertools.combinations(at, 2):
            if x[i] @ x[j] >= 0.8:
                root[find(i)] = find(j)
        parts = defaultdict(list)
        for i in at:
            parts[find(i)].append(e.id.values[i])
        true |= {(i, min(p)) for p in parts.values() if len(p) >= 5 for i in p}
    got = DensityClusters(spark.read.parquet(f"{small}/episodes.parquet"), **params).linked()
    assert pairs(got, "id", "cluster_key") == true


def test_p5_recall(spark, small, table_of):
    from episodica.llm.nn_descent import NeighbourGraph

    e, x = usable(table_of("episodes").drop_duplicates("id"))
    c = x @ x.T
    np.fill_diagonal(c, -2)
    near = {(e.id.values[i], e.id.values[j]) for i in range(len(x)) for j in np.argsort(-c[i])[:10]}
    graph = NeighbourGraph(spark.read.parquet(f"{small}/episodes.parquet"), cell_rows=128, cell_cap=256, rounds=2, fan=8)
    got = pairs(graph.neighbours(), "id", "neighbour_id")
    assert len(got & near) >= 0.9 * len(near)
    high = {tuple(sorted((e.id.values[i], e.id.values[j]))) for i, j in zip(*np.nonzero(c >= 0.975))}
    found = pairs(graph.exact_pairs(0.975), "id_a", "id_b")
    assert found <= high and len(found) >= 0.95 * len(high)
    queries = spark.read.parquet(f"{small}/episodes.parquet").where("id < '2'")
    hits = graph.search(queries).toPandas()
    asked = {i for i, _ in near if i < "2"}
    assert len({(a, b) for a, b in zip(hits.query_id, hits.id)} & near) >= 0.9 * 10 * len(asked)


def test_p5_topic_of_close_vectors(spark):
    from episodica.llm.nn_descent import NeighbourGraph

    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + rng.standard_normal((2000, 64)) * 0.143 / 8
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    y = x[:2000].astype(float)
    c = y @ y.T
    np.fill_diagonal(c, -2)
    near = {(min(i, j), max(i, j)) for i, z in enumerate(np.argpartition(-c, 10, axis=1)[:, :10].tolist()) for j in z if c[i, j] >= 0.975}
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "embedding": x.tolist()}))
    for params in ({}, {"cell_rows": 512, "cell_cap": 512}):
        graph = NeighbourGraph(df, least=0.975, **params)
        found = pairs(graph.exact_pairs(0.975), "id_a", "id_b")
        assert len(found & near) >= 0.9 * len(near)
        assert graph.changes[-1] <= graph.delta * graph.k * len(x)


def test_p7(spark, small, table_of):
    rows = q.p7_containers(spark, small).toPandas()
    docs = table_of("documents")
    assert set(rows.doc_id) == set(docs.doc_id)
    fill = rows.groupby("container").tokens.sum()
    assert fill.max() <= 2048 and len(fill[fill > 0]) <= -(-rows.tokens.sum() // 2048) + 1
    for _, p in rows.groupby("doc_id"):
        p = p.sort_values("piece")
        assert list(p.start) == [2048 * k for k in p.piece] and (p.tokens.iloc[:-1] == 2048).all()


def test_p2_and_p9_run(spark, small):
    found = q.p2_found(spark, small).toPandas()
    assert set(found.columns) == {"id", "field_name", "kind", "item_text"} and not found.duplicated().any()
    assert set(found.kind) <= {"email", "phone", "id_number", "address", "name"}
    assert q.p9_found(spark, small).columns == ["doc_id"]
