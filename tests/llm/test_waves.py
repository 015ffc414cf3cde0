"""Tables and block pairs worked off in waves: what lies on disk at once, and the same result as all pairs at once."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from episodica import workspace
from episodica.llm import density, kernels

PARAMS = {"bucket_rows": 200, "block_rows": 100, "miss": 0.01}


@pytest.fixture
def topics(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1000, 64))
    for k in range(0, 700, 70):
        x[k : k + 70] = x[k] / np.linalg.norm(x[k]) + rng.standard_normal((70, 64)) * 0.03
    # The first scope is hashed, with topics of 70; one of the others has two blocks in one bucket.
    scope = np.where(np.arange(1000) % 5 < 3, "a", np.where(np.arange(1000) % 10 < 8, "b", "c"))
    return spark.createDataFrame(pd.DataFrame({"id": [f"i{i:04d}" for i in range(1000)], "group_id": scope, "embedding": x.astype(np.float32).tolist()}))


def test_no_table_of_many_copies_of_the_vectors(topics, monkeypatch):
    written, wide = [], density.durable

    def counted(df, tag, *rest):
        out = wide(df, tag, *rest)
        if "vec" in out.columns:
            written.append((tag, out.count()))
        return out

    monkeypatch.setattr(density, "durable", counted)
    got = density.DensityClusters(topics, **PARAMS).linked().toPandas()
    assert written and all(n <= 1000 for _, n in written), written
    assert len(got) == 700


@pytest.mark.parametrize("min_samples", [4])
def test_many_waves_give_the_same(topics, monkeypatch, min_samples):
    want = density.DensityClusters(topics, min_samples=min_samples)
    links, members = (z.toPandas() for z in (want.linked(), want.clusters()[0]))
    monkeypatch.setattr(density, "_WAVE_ROWS", 0)
    got = density.DensityClusters(topics, min_samples=min_samples, **PARAMS)
    again = (z.toPandas() for z in (got.linked(), got.clusters()[0]))
    assert len(list(got.layout().waves(2 * 1000))) > 3 and len(members) > 600
    for one, two in zip((links, members), again):
        pd.testing.assert_frame_equal(one.sort_values("id").reset_index(drop=True), two.sort_values("id").reset_index(drop=True), atol=1e-4)
    assert not [p for _, p in workspace._written if "/wave-" in p]


def test_all_nodes_of_a_bucket_meet():
    from episodica.llm.layout import Layout, unpacked

    rng = np.random.default_rng(2)
    n = 4000
    x = rng.standard_normal((n, 64))
    x[:3000] = x[0] + rng.standard_normal((3000, 64)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
    node = rng.integers(0, 2**60, n)
    batch = pa.record_batch({"s": np.zeros(n, np.int64), "node": node, "copies": np.ones(n, np.int32), "core": np.zeros(n, np.float32), "vec": kernels.binary_column(x.ravel(), np.full(n, 64))})
    plan = Layout({0: n}, n, dim=64, cos=0.8, bucket_rows=1000, block_rows=300, miss=0.3, seed=11)
    buckets, first = {}, None
    for tables in ([0], list(range(1, plan.tables))):
        found = pa.Table.from_batches(list(plan.counted(tables)(iter([batch])))).to_pandas().groupby(["t", "bucket", "met"], as_index=False).n.sum()
        sizes = found.groupby(["t", "bucket"], as_index=False).n.sum()
        large = sizes[sizes.n > 300]
        apart = found[(found.met != 0) & (found.n > 300)]
        plan.divide(list(large.itertuples(index=False, name=None)), list(apart.itertuples(index=False, name=None)))
    assert len(plan.apart[1][0]) > 0
    for t, rows, key, met in plan._places(batch.column("s").to_numpy(), x, list(range(plan.tables)), {}, True):
        buckets[t] = (key, met)
    met_at, waves = set(), list(plan.waves(2 * n))
    for wave in waves:
        rows = 0
        for out in plan.dealt(wave)(iter([batch])):
            frame = pa.Table.from_batches([out])
            for k in set(frame["key"].to_pylist()):
                u = unpacked(frame.filter(pc.equal(frame["key"], k)), 64).to_pandas()
                rows += len(u)
                left, right = (u, u) if (u.side == 2).any() else (u[u.side == 0], u[u.side == 1])
                met_at.update((min(a, b), max(a, b)) for a in left.node for b in right.node)
        assert rows <= 2 * n
    at = {v: i for i, v in enumerate(node.tolist())}
    together = np.zeros((n, n), bool)
    for key, _ in buckets.values():
        together |= key[:, None] == key[None, :]
    have = np.zeros((n, n), bool)
    pairs = np.array([(at[a], at[b]) for a, b in met_at])
    have[pairs[:, 0], pairs[:, 1]] = have[pairs[:, 1], pairs[:, 0]] = True
    np.fill_diagonal(have, True)
    assert (have == together).all()
