"""Ranked retrieval: mode resolution, scoring, normalization and top-k as one declarative plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ilike, query_terms
from ..functions.vector import cosine
from ..operators import filters, keyword, ranking
from ..workspace import durable, spread
from .params import MODES, SearchParams

_SHOWN = ["id", "name", "source", "group_id", "created_at"]


def resolve(p: SearchParams, keyword_ready: bool = True) -> str:
    """The branch that answers: vector, keyword, hybrid or chronological."""
    mode = p.mode or "vector"
    if mode not in MODES:
        raise ValueError(f"unknown search mode: {mode}")
    if mode != "vector" and not keyword_ready:
        mode = "vector"
    vector = p.vector is not None and mode != "keyword"
    if mode != "vector" and p.query:
        return "hybrid" if mode == "hybrid" and vector else "keyword"
    return "vector" if vector else "chronological"


def _all(df: DataFrame, conditions) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def _boosted(df: DataFrame, p: SearchParams) -> DataFrame:
    if p.tags and p.tag_boost > 0:
        df = df.withColumn("relevance", F.col("relevance") + F.lit(round(p.tag_boost, 6)) * F.col("_ratio"))
    return df


def search(episodes: DataFrame, p: SearchParams, as_of: datetime, keyword_ready: bool = True) -> DataFrame:
    """(id, name, source, group_id, created_at, similarity, relevance), best first, ties by id.

    Filters apply before minimum and maximum are taken, so relevance is relative to the filtered set;
    keyword statistics come from all records. Rows that repeat an id are one record. Scores are taken
    row by row before repeated rows are folded, so vectors and texts are never shuffled.
    """
    branch = resolve(p, keyword_ready)
    boost = [filters.tag_ratio(p.tags).alias("_ratio")] if p.tags and p.tag_boost > 0 else []
    none = F.lit(None).cast("double")
    if branch == "chronological":
        rows = _all(episodes, filters.predicates(p, as_of)).select(*_SHOWN).dropDuplicates(["id"])
        return ranking.top(rows, p.limit, "created_at").select("*", none.alias("similarity"), none.alias("relevance"))
    if branch == "vector":
        rows = _all(episodes, filters.predicates(p, as_of, True)).select(*_SHOWN, *boost, cosine(F.col("embedding"), p.vector).alias("similarity")).dropDuplicates(["id"])
        out = ranking.with_range(rows, "similarity").withColumn("relevance", ranking.scaled("similarity"))
        out = _boosted(out, p)
        if p.min_similarity > 0:
            out = out.where(F.col("similarity") >= round(p.min_similarity, 6))
        return ranking.top(out, p.limit).select(*_SHOWN, "similarity", "relevance")
    terms = query_terms(p.query)
    similarity = [cosine(F.col("embedding"), p.vector).alias("similarity")] if branch == "hybrid" else []
    keep = F.lit(True)
    for c in filters.predicates(p, as_of, branch == "hybrid"):
        keep = keep & F.coalesce(c, F.lit(False))
    # The texts are read once: what is kept of a row is a few numbers, written before statistics and scores use them.
    needed = ["content", "expired_at", *_SHOWN, *(["tags"] if p.tags else []), *(["embedding"] if branch == "hybrid" else [])]
    counted = keyword.term_counts(spread(episodes.select(*needed)), terms, *_SHOWN, *boost, *similarity, keep.alias("_keep")).dropDuplicates(["id"])
    counted = durable(counted, "term-counts")
    stats = keyword.corpus_stats(counted, len(terms))
    scored = counted.crossJoin(F.broadcast(stats)).where("_keep").withColumn("bm25", keyword.bm25(len(terms)))
    if branch == "keyword":
        out = ranking.with_range(scored.where("bm25 is not null"), "bm25").select(*_SHOWN, *(["_ratio"] if boost else []), none.alias("similarity"), ranking.scaled("bm25").alias("relevance"))
        out = ranking.top(_boosted(out, p), p.limit).select(*_SHOWN, "similarity", "relevance")
        if p.mode == "keyword" and out.isEmpty():
            return substring_search(episodes, p, as_of)
        return out
    ranged = ranking.with_range(scored, "bm25", "similarity").where("bm25 is not null or similarity is not null")
    words = F.coalesce(ranking.scaled("bm25"), F.lit(0.0))
    near = F.coalesce(ranking.scaled("similarity"), F.lit(0.0))
    out = ranged.withColumn("relevance", F.lit(p.weight) * near + F.lit(1 - p.weight) * words)
    return ranking.top(_boosted(out, p), p.limit).select(*_SHOWN, "similarity", "relevance")


def substring_search(episodes: DataFrame, p: SearchParams, as_of: datetime) -> DataFrame:
    """What keyword search falls back to when nothing matched: substring hits, newest first; tags always filter."""
    hard = SearchParams(**(vars(p) | {"tag_boost": 0.0}))
    hit = contains_ilike(F.col("content"), p.query) | F.coalesce(contains_ilike(F.col("name"), p.query), F.lit(False))
    rows = _all(episodes, [*filters.predicates(hard, as_of), hit]).select(*_SHOWN).dropDuplicates(["id"])
    return ranking.top(rows, p.limit, "created_at").select("*", F.lit(None).cast("double").alias("similarity"), F.lit(1.0).alias("relevance"))
