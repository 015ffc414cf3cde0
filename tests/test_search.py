"""Searches on hand-built episodes."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row

from episodica.functions.embedders import endpoint_url
from episodica.functions.text import sanitize_query
from episodica.plans.params import SearchParams, memory_request, parse_time, request_params, update_request
from episodica.plans.search import resolve, search
from episodica.sources.schema import EPISODES

NOW = datetime(2024, 6, 1, tzinfo=UTC)


def episodes(spark, *rows):
    base = {f: None for f in EPISODES.fieldNames()}
    out = []
    for i, r in enumerate(rows):
        out.append(Row(**(base | {"id": f"e{i}", "content": "x", "name": "", "source": "test", "group_id": "default", "created_at": NOW - timedelta(hours=10 - i)} | r)))
    return spark.createDataFrame([tuple(r[f] for f in EPISODES.fieldNames()) for r in out], EPISODES)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def foxes(spark):
    return episodes(
        spark,
        {"content": "The quick brown fox jumps over the lazy dog", "name": "fox story", "embedding": [1.0, 0.0], "tags": ["a", "b"]},
        {"content": "A lazy cat sleeps all day", "name": "cat nap", "embedding": [0.0, 1.0], "tags": ["a"], "group_id": "g1"},
        {"content": "Quantum physics is strange", "name": "quantum", "embedding": [0.7, 0.7]},
        {"content": "expired", "embedding": [1.0, 0.0], "expired_at": NOW},
        {"content": "account 123456789012 opened", "group_id": "g1"},
    )


def test_vector(foxes):
    rows = search(foxes, SearchParams(vector=[1.0, 0.1]), NOW).collect()
    assert [r["id"] for r in rows] == ["e0", "e2", "e1"]
    assert rows[0]["relevance"] == 1 and rows[-1]["relevance"] == 0
    assert ids(search(foxes, SearchParams(vector=[1.0, 0.0], min_similarity=0.5), NOW)) == ["e0", "e2"]
    assert ids(search(foxes, SearchParams(vector=[1.0, 0.0], min_similarity=1.1), NOW)) == []
    assert "e3" in ids(search(foxes, SearchParams(vector=[1.0, 0.0], include_expired=True), NOW))


def test_vector_of_another_length_or_zero_has_no_similarity(spark):
    e = episodes(spark, {"embedding": [1.0, 0.0]}, {"embedding": [1.0]}, {"embedding": [0.0, 0.0]}, {"embedding": [float("nan"), 1.0]})
    rows = search(e, SearchParams(vector=[1.0, 0.0]), NOW).collect()
    assert [r["id"] for r in rows] == ["e0", "e1", "e2", "e3"]
    assert [r["similarity"] for r in rows] == [1.0, None, None, None]


def test_keyword(foxes):
    assert set(ids(search(foxes, SearchParams(query="lazy", mode="keyword"), NOW))) == {"e0", "e1"}
    assert ids(search(foxes, SearchParams(query="elephants", mode="keyword"), NOW)) == []
    assert ids(search(foxes, SearchParams(query="lazy", mode="keyword", group_id="g1"), NOW)) == ["e1"]
    only = search(foxes, SearchParams(query="quantum", mode="keyword"), NOW).collect()
    assert only[0]["relevance"] == 1 and only[0]["similarity"] is None


def test_numbers_fall_back_to_substrings(foxes):
    rows = search(foxes, SearchParams(query="123456789012", mode="keyword"), NOW).collect()
    assert [(r["id"], r["relevance"]) for r in rows] == [("e4", 1.0)]
    assert ids(search(foxes, SearchParams(query="123456789012", mode="keyword", group_id="default"), NOW)) == []
    assert ids(search(foxes, SearchParams(query="123456789012", mode="hybrid"), NOW)) == []


def test_hybrid(foxes):
    both = search(foxes, SearchParams(query="lazy", mode="hybrid", vector=[1.0, 0.0]), NOW).collect()
    assert both[0]["id"] == "e0" and "e4" not in [r["id"] for r in both]
    assert ids(search(foxes, SearchParams(query="lazy", mode="hybrid", vector=[0.0, 1.0], alpha=1.0), NOW))[0] == "e1"


@pytest.mark.parametrize("p", [SearchParams(vector=[1.0, 0.2], tags=["a", "b"], tag_boost=0.5), SearchParams(query="lazy fox", mode="keyword", tags=["a"], tag_boost=0.5), SearchParams(query="lazy fox", mode="hybrid", vector=[1.0, 0.0], tags=["a"], tag_boost=0.5)])
def test_relevance_falls_and_is_bounded(foxes, p):
    r = [x["relevance"] for x in search(foxes, p, NOW).collect()]
    assert r == sorted(r, reverse=True) and all(0 <= x <= 1.5 for x in r)


def test_tags_filter_or_boost(foxes):
    assert ids(search(foxes, SearchParams(tags=["a", "b"]), NOW)) == ["e0"]
    assert len(ids(search(foxes, SearchParams(vector=[0.0, 1.0], tags=["a", "b"], tag_boost=1.5), NOW))) == 3


def test_ladder():
    v = [1.0]
    assert resolve(SearchParams(vector=v)) == "vector"
    assert resolve(SearchParams()) == "chronological"
    assert resolve(SearchParams(query="x", mode="keyword", vector=v)) == "keyword"
    assert resolve(SearchParams(query="x", mode="hybrid")) == "keyword"
    assert resolve(SearchParams(query="x", mode="hybrid", vector=v)) == "hybrid"
    assert resolve(SearchParams(mode="hybrid", vector=v)) == "vector"
    assert resolve(SearchParams(mode="keyword", vector=v)) == "chronological"
    assert resolve(SearchParams(query="x", mode="keyword", vector=v), keyword_ready=False) == "vector"
    assert resolve(SearchParams(query="x", mode="hybrid", vector=v), keyword_ready=False) == "vector"


def test_repeated_rows_and_empty_table(spark, foxes):
    twice = foxes.union(foxes)
    for p in (SearchParams(vector=[1.0, 0.0]), SearchParams(query="lazy", mode="keyword"), SearchParams()):
        assert search(twice, p, NOW).collect() == search(foxes, p, NOW).collect()
        assert search(foxes.limit(0), p, NOW).collect() == []


@pytest.mark.parametrize(("given", "wanted"), [("hello world", "hello world"), ('say "hi"', "say hi"), ("foo-bar", "foobar"), ("a + b", "a  b"), ("it's", "it''s"), ("x--y", "xy"), ("/* c */", " c "), ("f(x);", "fx"), ("a\\b*", "ab"), ("", "")])
def test_sanitize(given, wanted):
    assert sanitize_query(given) == wanted


def test_profiles():
    assert request_params("rest", {}).group_id == "default" and request_params("mcp", {}).group_id == ""
    for bad in ({"search_mode": "fuzzy"}, {"alpha": 1.5}, {"before": "yesterday"}):
        with pytest.raises(ValueError):
            request_params("rest", bad)
    assert request_params("mcp", {"before": "yesterday"}).before is None
    assert parse_time("2024-03-01T10:00:00.5Z", True).microsecond == 500000
    with pytest.raises(ValueError):
        memory_request("rest", {"content": "x"})
    assert update_request("rest", {"tags": []}).given() == {"tags": []}
    with pytest.raises(ValueError):
        update_request("mcp", {"tags": []})


def test_endpoints():
    assert [endpoint_url(u) for u in ("http://h", "http://h/", "http://h/v1", "http://h/v1/embeddings")] == ["http://h/v1/embeddings"] * 2 + ["http://h/v1/embeddings"] * 2
