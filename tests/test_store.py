"""The log-structured store, re-embedding and streaming ingestion."""

from datetime import UTC, datetime, timedelta

import pytest

from episodica.functions.embedders import HashEmbedder
from episodica.plans.params import UpdateParams
from episodica.plans.reembed import page, reembed, targets
from episodica.sources.schema import EPISODE_COLS
from episodica.sources.store import EpisodeStore, upgraded
from episodica.streaming.ingest import ingest

NOW = datetime(2024, 6, 1, tzinfo=UTC)


@pytest.fixture
def store(spark, tmp_path):
    s = EpisodeStore(spark, f"file://{tmp_path}/store", dim=4)
    s.append(spark.createDataFrame([("a", "one", "test", ["x"], "{}"), ("b", "two", "test", [], "")], "id string, content string, source string, tags array<string>, metadata string"), NOW)
    return s


def test_defaults_and_lookup(store):
    b = store.get("b")
    assert list(b) == EPISODE_COLS
    assert (b["group_id"], b["tags"], b["metadata"], b["name"]) == ("default", None, None, "")
    with pytest.raises(KeyError):
        store.get("none")


def test_generated_ids_and_required_fields(store, spark):
    store.append(spark.createDataFrame([("three", "test")], "content string, source string"), NOW)
    assert store.episodes().count() == 3
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "content string"))
    with pytest.raises(Exception, match="not of length"):
        store.append(spark.createDataFrame([("x", "t", [1.0])], "content string, source string, embedding array<float>"))
    assert store.episodes().count() == 3


def test_update_delete_compact(store, spark):
    with pytest.raises(ValueError):
        store.update("a", UpdateParams())
    with pytest.raises(KeyError):
        store.update("none", UpdateParams(tags=["y"]))
    store.update("a", UpdateParams(tags=["y"]))
    store.update("a", UpdateParams(expired_at=NOW - timedelta(hours=1)))
    a = store.get("a")
    assert a["tags"] == ["y"] and a["expired_at"] is not None and a["metadata"] == "{}"
    assert store.count(NOW) == 1
    store.delete("b")
    assert store.count(NOW) == 0
    store.compact()
    assert [r["id"] for r in store.episodes().collect()] == ["a"] and store.get("a")["tags"] == ["y"]
    store.append(spark.createDataFrame([("b", "again", "test")], "id string, content string, source string"), NOW)
    assert store.get("b")["content"] == "again"
    store.update("b", UpdateParams(tags=["z"]))
    store.delete("b")
    with pytest.raises(KeyError):
        store.get("b")
    store.append(spark.createDataFrame([("b", "again", "test")], "id string, content string, source string"), NOW)
    assert store.get("b")["tags"] is None
    again = EpisodeStore(spark, store.path)
    assert again.version == store.version and again.episodes().count() == 2


def test_reembed(store, spark):
    store.append(spark.createDataFrame([("c", "gone", "test", NOW - timedelta(days=1))], "id string, content string, source string, expired_at timestamp"), NOW)
    e = HashEmbedder("m1", 4)
    assert store.count_stale("m1", NOW) == 2
    assert [r["id"] for r in page(targets(store.episodes(), "m1", NOW), "a").collect()] == ["b"]
    status = reembed(store, e, 4, NOW)
    assert (status.total, status.done, status.failed) == (2, 2, 0)
    assert store.count_stale("m1", NOW) == 0 and store.count_stale("m2", NOW) == 2 and store.count_stale("m1", NOW, True) == 2
    with pytest.raises(ValueError):
        reembed(store, e, 5, NOW)


def test_upgrade_adds_columns(spark):
    old = spark.createDataFrame([("a", "x", "test")], "id string, content string, source string")
    assert "embedding_model" in upgraded(old).columns


def test_streaming(store, spark, tmp_path):
    rows = spark.createDataFrame([("s1", "streamed", "test")], "id string, content string, source string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest(stream, store, f"{tmp_path}/checkpoint").awaitTermination(60)
    assert store.get("s1")["content"] == "streamed"
