"""Nulls, empty and long texts, ties, repeated rows, empty tables and other columns; hand-built truths."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from episodica.llm import kernels
from episodica.llm.cooccurrence import associations
from episodica.llm.density import DensityClusters
from episodica.llm.leakage import leaked
from episodica.llm.near_duplicates import similar_classes, similar_pairs
from episodica.llm.nn_descent import NeighbourGraph
from episodica.llm.packing import knapsack, pack, solve
from episodica.llm.personal import find, redact
from episodica.llm.spam_pages import stuffed_pages, stuffed_share
from episodica.llm.splitting import boundary_table, range_pieces, split_files, split_texts, stitch

TEXT = " ".join(f"w{i}" for i in range(60))
WIDE = "id string, content string, group_id string, key long, n int, class string, tokens string, text string"


def wide(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", "t", "x") for r in rows], WIDE)


def test_near_duplicates(spark):
    rows = [("a", TEXT, "g"), ("a", TEXT, "g"), ("b", TEXT, "g"), ("c", TEXT + " end", "g"), ("d", TEXT, "h"), ("e", TEXT, None), ("f", None, "g"), (None, TEXT, "g"), ("h", "", "g"), ("i", "short text", "g"), ("j", "z " * 200_000, "g")]
    got = {(r.id_a, r.id_b) for r in similar_pairs(wide(spark, rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    classes = {r.id: (r.class_id, r.copies, r.links) for r in similar_classes(wide(spark, rows)).collect()}
    assert classes["b"] == ("a", 2, 1) and classes["c"] == ("c", 1, 1) and classes["d"] == ("d", 1, 0)
    assert similar_pairs(wide(spark, rows).limit(0)).count() == 0


def test_personal(spark):
    parts = spark.createDataFrame([("Aelric", "given"), ("Noor", "given"), ("Trevmox", "family"), ("Karvmox", "family"), ("Pellmox", "family"), ("Ulmmox", "family"), ("Stenbrook", "family")], "name_part string, part_kind string")
    text = "Signed: Aelric Trevmox, +44 20 7946 0123, a.trevmox@garden.example\nPinned loader@2.1.4 after MEM-22."
    rows = [("a", text, "SSN 923-04-5640"), ("a", text, "SSN 923-04-5640"), ("b", None, ""), ("c", "", None), (None, text, None), ("e", "x" * 300_000, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, content string, source_description string, kind string")
    got = {tuple(r) for r in find(df, parts).collect()}
    assert got == {("a", "content", "name", "Aelric Trevmox"), ("a", "content", "phone", "+44 20 7946 0123"), ("a", "content", "email", "a.trevmox@garden.example"), ("a", "source_description", "id_number", "923-04-5640")}
    out = {r.id: r for r in redact(df, parts).collect()}
    assert out["a"].content == "Signed: [NAME], [PHONE], [EMAIL]\nPinned loader@2.1.4 after MEM-22." and out["b"].content is None and out["c"].content == ""
    assert find(df.limit(0), parts).count() == 0


def test_personal_refuses_a_list_of_names_it_would_have_to_cut(spark):
    parts = spark.range(20_001).selectExpr("concat('Name', id) AS name_part", "'given' AS part_kind")
    df = spark.createDataFrame([("a", "x", "y")], "id string, content string, source_description string")
    for f in (find, redact):
        with pytest.raises(ValueError, match="name_parts"):
            f(df, parts)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 5, "n") for r in rows], "id string, group_id string, embedding array<float>, node long, vec string")


def test_vectors(spark):
    one, near = [1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62
    rows = [(f"a{i}", "g", one) for i in range(4)] + [("b", "g", near), ("b", "g", near), ("c", "h", one), ("d", None, one), (None, "g", one), ("e", "g", None), ("f", "g", [0.0] * 64), ("h", "g", [1.0]), ("i", "g", [float("nan")] * 64), ("j", "g", [-1.0] + [0.0] * 63)]
    df = vectors(spark, rows)
    got = {tuple(r) for r in DensityClusters(df).linked().collect()}
    assert got == {(i, "a0") for i in ("a0", "a1", "a2", "a3", "b")}
    assert DensityClusters(df.limit(0)).linked().count() == 0
    pairs = {(r.id_a, r.id_b) for r in NeighbourGraph(df).exact_pairs(0.975).collect()}
    assert ("a0", "a1") in pairs and ("a0", "c") in pairs and len(pairs) == 21
    assert NeighbourGraph(df.limit(0)).exact_pairs(0.975).count() == 0


def test_hierarchy_splits_where_denser_parts_are_more_stable(spark):
    def at(degrees, axis):
        v = [0.0] * 64
        v[0], v[1] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        v[axis] += 0.01
        return [float(x) for x in v]

    rows = [(f"a{i}", "g", at(0, 2 + i)) for i in range(7)] + [(f"b{i}", "g", at(30, 20 + i)) for i in range(7)] + [(f"z{i}", "g", at(120 + 60 * i, 40)) for i in range(3)]
    members, described = DensityClusters(vectors(spark, rows), min_samples=3).clusters()
    got = {r.cluster_key: (r.size, r.exemplars.split(",")[0][0]) for r in described.collect()}
    assert got == {"a0": (7, "a"), "b0": (7, "b")} and members.count() == 14
    assert {r.cluster_key for r in DensityClusters(vectors(spark, rows)).linked().collect()} == {"a0"}
    assert DensityClusters(vectors(spark, rows).limit(0), min_samples=3).clusters()[1].count() == 0


def test_large_scope_with_a_dense_topic(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 64))
    for first, n, spread in ((0, 200, 0.02), (200, 60, 0.06), (260, 40, 0.07)):
        x[first : first + n] = x[first] / np.linalg.norm(x[first]) + rng.standard_normal((n, 64)) * spread
    rows = [(f"r{i:03}", "g", v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    whole, parts = (DensityClusters(vectors(spark, rows), min_samples=3, **p) for p in ({}, {"bucket_rows": 48, "block_rows": 12, "miss": 1e-5}))
    assert sorted(map(tuple, whole.linked().collect())) == sorted(map(tuple, parts.linked().collect()))
    one, two = ({r.id: (r.cluster_key, pytest.approx(r.persistence, rel=1e-3)) for r in z.clusters()[0].collect()} for z in (whole, parts))
    assert one.keys() == two.keys() and all(one[k][0] == two[k][0] and one[k][1].expected == two[k][1] for k in one)


def test_dense_block_holds_few_links(spark, monkeypatch):
    import pyarrow as pa

    from episodica.llm import density
    from episodica.llm.forest import local_forest

    rng = np.random.default_rng(1)
    n = 3000
    x = np.zeros((n, 64)) + np.eye(64)[0] + rng.standard_normal((n, 64)) * 0.02
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")
    monkeypatch.setattr(density, "_LINKS", 200_000)
    node = np.sort(rng.integers(0, 2**60, n))
    block = pa.table({"vec": kernels.binary_column(x.ravel(), np.full(n, 64)), "side": np.full(n, 2), "node": node, "core": np.zeros(n, np.float32), "copies": np.ones(n, np.int32)})
    whole = [np.concatenate(z) for z in zip(*density._similar(block, 64, 0.8))]
    keep, _ = local_forest(whole[0], whole[1], 1 - whole[2], n, node)
    most = []

    def counted(u, *rest):
        most.append(len(u))
        return local_forest(u, *rest)

    monkeypatch.setattr(density, "local_forest", counted)
    out = density.thinned(block, 64, 0.8)
    assert max(most) <= 2 * 200_000 + n and len(whole[0]) > 4_000_000
    assert sorted(zip(out["a"].to_pylist(), out["b"].to_pylist())) == sorted(zip(node[whole[0][keep]].tolist(), node[whole[1][keep]].tolist()))
    best = density.nearest(block, 64, 0.8, 5).to_pandas()
    c = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(c, -2)
    assert (best.groupby("node").size() == 5).all()
    assert np.allclose(best.groupby("node").distance.max().values, 1 - np.sort(c, axis=1)[:, -5], atol=1e-5)


def test_cooccurrence(spark):
    rows = [("a", ["X ", "y", None, "", "x"]), ("a", ["X ", "y", None, "", "x"]), ("b", ["x", "z"]), ("c", None), ("d", []), (None, ["x", "y"]), ("e", ["y"])]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "id string, tags array<string>, item string, salt int")
    got = {(r.item_a, r.item_b): (r.ab, r.a, r.b, r.n) for r in associations(df).collect()}
    assert got == {("x", "y"): (1, 2, 2, 3), ("x", "z"): (1, 2, 1, 3)}
    assert associations(df.limit(0)).count() == 0


def test_leakage(spark):
    item = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"x {item.upper().replace(' ', ' - ')} y"), (1, f"x {item.upper().replace(' ', ' - ')} y"), (2, " ".join(item.split()[:12])), (3, None), (4, ""), (5, "w " * 300_000 + " ".join(item.split()[5:18])), (None, item), (7, " ".join(item.split()[:7]) + " gap " + " ".join(item.split()[7:]) )]
    d = spark.createDataFrame([(*r, "i") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(10, item), (10, item), (11, item), (12, "too short"), (13, None)], "item_id long, item_text string")
    assert {tuple(r) for r in leaked(d, i).collect()} == {(1, 10), (1, 11), (5, 10), (5, 11), (7, 10), (7, 11)}
    assert {tuple(r) for r in leaked(d, i, pass_words=5).collect()} == {(1, 10), (1, 11), (5, 10), (5, 11), (7, 10), (7, 11)}
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0


def test_spam(spark):
    stuffed = "cheap desk lamp buy desk lamp best desk lamp price " * 20
    honest = "\n".join(f"[guide {w}](https://docs.example/{w})" for w in "alpha beta gamma delta epsilon zeta".split())
    rows = [(1, stuffed), (1, stuffed), (2, honest), (3, None), (4, ""), (5, "The agent wrote the note and it was kept in the log. " * 30), (None, stuffed), (7, "...")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, stuffed double")
    assert [r.doc_id for r in stuffed_pages(df).collect()] == [1]
    assert stuffed_pages(df.limit(0)).count() == 0
    assert stuffed_share("buy lamp " * 100_000) > 0.5


def test_spam_without_ascii_sales_words(spark):
    brands = "\n".join(f"oak DeskMax pine LampPlus {w}" for w in ["red", "blue", "green", "grey"] * 20)
    accents = "\n".join(f"lampe günstig envío {w}" for w in ["rot", "blau", "grau", "weiss"] * 20)
    df = spark.createDataFrame([(1, brands), (2, accents), (3, "oak table pine lamp red\n" * 20)], "doc_id long, text string")
    assert {r.doc_id for r in stuffed_pages(df).collect()} == {1, 2}


def test_spam_of_product_tags_and_places(spark):
    tags = " ".join(f"#{a}{b}" for a in ("buy", "cheap", "best", "rabatt") for b in ("desklamp", "phonecase", "storagebox", "cabletidy"))
    places = " | ".join(f"{w}desk lamp {p}" for p in ["Eastfold", "Northmere", "Bay"] * 10 for w in (["", "", "best in "] if p == "Bay" else [""]))
    topics = " ".join(f"#{a}" for a in "memory agents recall notes episodes newsletter topics saleable".split() * 4)
    table = " | ".join(f"desk lamp {p}" for p in ["Eastfold", "Northmere", "Bay"] * 10)
    df = spark.createDataFrame([(1, tags), (2, places), (3, topics), (4, table)], "doc_id long, text string")
    assert {r.doc_id for r in stuffed_pages(df).collect()} == {1, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("buy cheap the note was kept . \n | , #buylamp LampPro https://a.example/b 10-pack lamp desk in of günstig".split(" ")), max_size=60))
def test_no_stuffed_page_is_skipped(parts):
    from episodica.llm.spam_pages import may_be_stuffed

    text = " ".join(parts)
    assert may_be_stuffed(text, 0.5) or stuffed_share(text) <= 0.5


def test_packing(spark):
    rows = [("a", 5000), ("b", 0), ("c", 48), ("c", 48), (None, 2000)]
    got = pack(spark.createDataFrame([(*r,) for r in rows], "id string, tokens long")).toPandas()
    assert got.tokens.sum() == 7096 and got.groupby("container").tokens.sum().max() <= 2048 and len(got) == 7
    assert sorted(got[got.id == "a"].start) == [0, 2048, 4096]
    assert pack(spark.createDataFrame([], "id string, tokens long")).count() == 0
    best = knapsack(np.array([1.0, 2.1, 2.9]), 7)
    assert (best * np.array([1, 2, 3])).sum() <= 7 and abs((best * np.array([1.0, 2.1, 2.9])).sum() - 7.3) < 1e-9


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_plan_holds_exactly_the_items(sizes):
    h = np.bincount(np.array(sizes, int) - 1, minlength=50) if sizes else np.zeros(50, int)
    plan = solve(h, 50, rounds=5)
    assert (sum((c * k for c, k in plan), np.zeros(50, int)) == h).all()
    assert all((c * np.arange(1, 51)).sum() <= 50 for c, _ in plan)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\t\r!é", max_size=80), st.integers(1, 9))
def test_ranges_do_not_change_boundaries(text, size):
    whole = stitch([boundary_table(text)])
    assert stitch([boundary_table(text[k : k + size], k) for k in range(0, len(text), size)])[1] == whole[1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n", min_size=1, max_size=300), st.integers(20, 60))
def test_pieces_cover_the_text(text, size):
    at = 0
    for lo in range(0, len(text), size):
        hi = min(lo + size, len(text))
        a = max(0, lo - 30)
        for s, e, _ in range_pieces(text[a : hi + 50], lo - a, hi - a, a, len(text), 20, 5):
            assert s <= at and e - s <= 20 and (at == 0 or at - s <= 5)
            at = e
    assert at == len(text)


def test_splitting(spark, tmp_path):
    text = "\n\n".join(f"Absatz {i} über etwas. " + "wörter " * 60 for i in range(200))
    rows = [("a", text), ("a", text), ("b", None), ("c", ""), (None, "x"), ("d", "é" * 5000)]
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], "id string, content string, start int, piece string")
    got = split_texts(df, range_chars=7000).toPandas().sort_values(["id", "piece"])
    for i, whole in (("a", text), ("d", "é" * 5000)):
        p, at = got[got.id == i], 0
        for s, t in zip(p.start, p.text):
            assert s <= at and whole[s : s + len(t)] == t and len(t) <= 2000
            at = s + len(t)
        assert at == len(whole)
    assert set(got.id) == {"a", "d"} and split_texts(df.limit(0)).count() == 0
    (tmp_path / "f.txt").write_text(text, encoding="utf-8", newline="")
    f = split_files(spark, [str(tmp_path / "f.txt")], range_bytes=9001).toPandas().sort_values("piece")
    at = 0
    for s, t in zip(f.start, f.text):
        assert s <= at and text[s : s + len(t)] == t
        at = s + len(t)
    assert at == len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é-K\n", max_size=30), max_size=8))
def test_word_hashes(texts):
    import re

    hashes, first, last = kernels.words(texts)
    seen = {}
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t.lower())
        assert last[i] - first[i] == len(w)
        for x, h in zip(w, hashes[first[i] : last[i]]):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
