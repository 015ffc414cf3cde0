"""The named queries over the store's tables, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators import filters, keyword, ranking
from ..sources.tables import table
from ..workspace import spread
from . import reembed, requests
from .params import SearchParams
from .search import search, substring_search

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 6, 1, tzinfo=UTC)
MODEL, DIM = "nest-embed-v2", 64
_AFTER, _BEFORE = datetime(2024, 2, 1, tzinfo=UTC), datetime(2024, 4, 1, tzinfo=UTC)
_TEXT, _TAGS = "cursor skipped threshold", ["docs", "token"]
_KEYWORD = SearchParams(query=_TEXT, mode="keyword", max_results=20)
_VECTOR = SearchParams(max_results=20)
_HYBRID = SearchParams(query=_TEXT, mode="hybrid", max_results=20)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the smallest id that has a usable one."""
    rows = table(spark, d, "episodes").select("id", "embedding").where(F.size("embedding") == DIM)
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("embedding", lambda x: x != 0)
    return [float(x) for x in rows.where(usable).agg(F.min_by("embedding", "id")).first()[0]]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "source", "group_id", F.unix_micros("created_at").alias("created_us"), F.round("similarity", 6).alias("similarity"), F.round("relevance", 6).alias("relevance"))


def _searched(p: SearchParams, vector: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = replace(p, vector=_query_vector(spark, d)) if vector else p
        return _shown(search(table(spark, d, "episodes"), q, AS_OF))
    return run


def _filtered(condition: Callable[[], Column]) -> Query:
    # The condition is built when the query runs: a Column needs a session.
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "episodes").where(condition()).select("id", "source", "group_id").distinct()
    return run


def _get_episode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "episodes")
    first = rows.agg(F.max("id")).first()[0]
    return rows.where(F.col("id") == first).select("id", "content", "name", "source", "source_model", "source_description", "group_id", F.unix_micros("created_at").alias("created_us"), "metadata").limit(1)


def _counted(condition: Callable[[], Column]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "episodes").where(condition()).agg(F.countDistinct("id").alias("n"))
    return run


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return reembed.targets(table(spark, d, "episodes").select("id", "content", "embedding", "embedding_model", "expired_at"), MODEL, AS_OF)


def _reembed_page(spark: SparkSession, d: str) -> DataFrame:
    return reembed.page(_targets(spark, d).dropDuplicates(["id"]), "8").select("id", F.length("content").cast("long").alias("chars"))


def _keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    index = keyword.postings(spread(table(spark, d, "episodes").select("id", "content", "name")))
    e = table(spark, d, "episodes").select("id", keyword.tokens(F.col("content"), F.col("name")).alias("w")).dropDuplicates(["id"]).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("a")).first()
    scores = keyword.bm25_from_postings(index, query_terms(_TEXT), e["n"], e["a"] or 1.0)
    return ranking.top(scores.select("id", F.round("score", 6).alias("score")), 50, "score")


def _updated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").select("id", "tags", "expired_at", "metadata", "source").dropDuplicates(["id"])
    out = requests.with_updates(e, table(spark, d, "episode_updates")).where("updates is not null")
    return out.select("id", F.array_join(F.transform("tags", lambda x: F.coalesce(x, F.lit("-"))), ",").alias("tags"), F.unix_micros("expired_at").alias("expired_us"), "metadata", "source", "updates")


def _substring(spark: SparkSession, d: str) -> DataFrame:
    return _shown(substring_search(table(spark, d, "episodes"), SearchParams(query="-451", mode="keyword", max_results=20), AS_OF))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return requests.checked_requests(table(spark, d, "search_requests"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return requests.run_summary(table(spark, d, "reembed_runs"))


def queries() -> dict[str, Query]:
    return {
        "get_episode": _get_episode,
        "filter_group": _filtered(lambda: F.col("group_id") == "default"),
        "filter_source": _filtered(lambda: F.col("source") == "ide-plugin"),
        "filter_before_after": _filtered(lambda: (F.col("created_at") < F.lit(_BEFORE)) & (F.col("created_at") > F.lit(_AFTER))),
        "filter_live": _filtered(lambda: filters.live(AS_OF)),
        "filter_tags_all": _filtered(lambda: filters.has_tags(_TAGS)),
        "chronological": _searched(SearchParams(group_id="default", max_results=25)),
        "vector_topk": _searched(_VECTOR, True),
        "vector_filtered": _searched(replace(_VECTOR, group_id="default", source="desk-client"), True),
        "vector_min_similarity": _searched(replace(_VECTOR, min_similarity=0.25), True),
        "vector_tag_boost": _searched(replace(_VECTOR, tags=_TAGS, tag_boost=0.5), True),
        "keyword_bm25": _searched(_KEYWORD),
        "keyword_filtered": _searched(replace(_KEYWORD, group_id="default", tags=["docs"])),
        "keyword_tag_boost": _searched(replace(_KEYWORD, tags=_TAGS, tag_boost=1.0)),
        "keyword_ilike_fallback": _searched(SearchParams(query="451", mode="keyword", max_results=20)),
        "substring_search": _substring,
        "keyword_postings": _keyword_postings,
        "hybrid_default": _searched(_HYBRID, True),
        "hybrid_alpha": _searched(replace(_HYBRID, alpha=0.3, include_expired=True), True),
        "hybrid_no_embedding": _searched(_HYBRID),
        "hybrid_tag_boost": _searched(replace(_HYBRID, tags=_TAGS, tag_boost=0.5), True),
        "count_live": _counted(lambda: filters.live(AS_OF)),
        "count_stale": _counted(lambda: filters.live(AS_OF) & filters.stale(MODEL)),
        "count_force": _counted(lambda: filters.live(AS_OF)),
        "stale_list": lambda spark, d: _targets(spark, d).select("id").distinct(),
        "reembed_page": _reembed_page,
        "mutation_log_fold": _updated,
        "request_validation": _requests,
        "reembed_status": _runs,
    }


# --- the same results in SQL -------------------------------------------------------------------

_E = "e AS (SELECT DISTINCT ON (id) * FROM episodes)"
_NOW = "TIMESTAMPTZ '2024-06-01 00:00:00+00'"
_LIVE = f"(expired_at IS NULL OR expired_at > {_NOW})"
_COLS = "id, name, source, group_id, epoch_us(created_at) AS created_us"
_V = "embedding::DOUBLE[]"
_Q = f"""q AS (SELECT {_V} AS v FROM episodes WHERE len(embedding) = 64 AND isfinite(CASE WHEN len(embedding) = 64 THEN list_inner_product({_V}, {_V}) END)
  AND CASE WHEN len(embedding) = 64 THEN list_inner_product({_V}, {_V}) END > 0 ORDER BY id LIMIT 1)"""
_SIM = f"""CASE WHEN len(embedding) = 64 AND isfinite(CASE WHEN len(embedding) = 64 THEN list_inner_product({_V}, {_V}) END) AND CASE WHEN len(embedding) = 64 THEN list_inner_product({_V}, {_V}) END > 0
  THEN CASE WHEN len(embedding) = 64 THEN list_cosine_similarity({_V}, v) END END"""
_HAS = " AND ".join(f"coalesce(list_contains(tags, '{t}'), false)" for t in _TAGS)
_RATIO = "((" + " + ".join(f"coalesce(list_contains(tags, '{t}'), false)::INT" for t in _TAGS) + f") / {len(_TAGS)}.0)"
_TERMS = query_terms(_TEXT)


def _vector_sql(where: str = "true", boost: str = "0", least: str = "") -> str:
    return f"""WITH {_E}, {_Q}, s AS (SELECT e.*, {_SIM} AS sim FROM e, q WHERE embedding IS NOT NULL AND {_LIVE} AND {where}),
r AS (SELECT min(sim) AS lo, max(sim) AS hi FROM s)
SELECT {_COLS}, round(sim, 6) AS similarity, round((CASE WHEN sim IS NULL THEN NULL WHEN lo = hi THEN 1.0 ELSE (sim - lo) / (hi - lo) END) + {boost}, 6) AS relevance
FROM s, r {least} ORDER BY (CASE WHEN sim IS NULL THEN NULL WHEN lo = hi THEN 1.0 ELSE (sim - lo) / (hi - lo) END) + {boost} DESC NULLS LAST, id LIMIT 20"""


def _counts_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{_E}, w AS (SELECT *, list_filter(string_split_regex(lower(concat_ws(' ', content, name)), '[^a-z]+'), lambda x: x <> '') AS w FROM e),
t AS (SELECT *, len(w) AS dl, {tf} FROM w), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM t),
b AS (SELECT t.*, CASE WHEN {hit} THEN {score} END AS bm FROM t, c)"""


def _keyword_sql(where: str = "true", boost: str = "0") -> str:
    rel = f"(CASE WHEN lo = hi THEN 1.0 ELSE (bm - lo) / (hi - lo) END + {boost})"
    return f"""WITH {_counts_sql(_TERMS)}, s AS (SELECT * FROM b WHERE bm IS NOT NULL AND {_LIVE} AND {where}), r AS (SELECT min(bm) AS lo, max(bm) AS hi FROM s)
SELECT {_COLS}, NULL::DOUBLE AS similarity, round({rel}, 6) AS relevance FROM s, r ORDER BY {rel} DESC, id LIMIT 20"""


def _hybrid_sql(alpha: float, live: str = _LIVE, boost: str = "0") -> str:
    rel = f"({alpha} * (CASE WHEN sim IS NULL THEN 0 WHEN slo = shi THEN 1.0 ELSE (sim - slo) / (shi - slo) END) + (1 - {alpha}::DOUBLE) * (CASE WHEN bm IS NULL THEN 0 WHEN blo = bhi THEN 1.0 ELSE (bm - blo) / (bhi - blo) END) + {boost})"
    return f"""WITH {_counts_sql(_TERMS)}, {_Q}, s AS (SELECT b.*, {_SIM} AS sim FROM b, q WHERE embedding IS NOT NULL AND {live}),
r AS (SELECT min(bm) AS blo, max(bm) AS bhi, min(sim) AS slo, max(sim) AS shi FROM s)
SELECT {_COLS}, round(sim, 6) AS similarity, round({rel}, 6) AS relevance FROM s, r WHERE bm IS NOT NULL OR sim IS NOT NULL ORDER BY {rel} DESC, id LIMIT 20"""


def _newest_sql(where: str, relevance: str, limit: int) -> str:
    return f"WITH {_E} SELECT {_COLS}, NULL::DOUBLE AS similarity, {relevance} AS relevance FROM e WHERE {_LIVE} AND {where} ORDER BY created_at DESC NULLS LAST, id LIMIT {limit}"


def _filter_sql(where: str) -> str:
    return f"SELECT DISTINCT id, source, group_id FROM episodes WHERE {where}"


def oracle_sql() -> dict[str, str]:
    stale = f"{_LIVE} AND (embedding IS NULL OR embedding_model IS DISTINCT FROM '{MODEL}')"
    last = ", ".join(f"(list({c} ORDER BY requested_at DESC NULLS LAST, update_id DESC) FILTER (WHERE {c} IS NOT NULL))[1] AS {c}" for c in ("tags", "expired_at", "metadata", "source"))
    return {
        "get_episode": "SELECT DISTINCT id, content, name, source, source_model, source_description, group_id, epoch_us(created_at) AS created_us, metadata FROM episodes WHERE id = (SELECT max(id) FROM episodes)",
        "filter_group": _filter_sql("group_id = 'default'"),
        "filter_source": _filter_sql("source = 'ide-plugin'"),
        "filter_before_after": _filter_sql("created_at < TIMESTAMPTZ '2024-04-01 00:00:00+00' AND created_at > TIMESTAMPTZ '2024-02-01 00:00:00+00'"),
        "filter_live": _filter_sql(_LIVE),
        "filter_tags_all": _filter_sql(_HAS),
        "chronological": _newest_sql("group_id = 'default'", "NULL::DOUBLE", 25),
        "vector_topk": _vector_sql(),
        "vector_filtered": _vector_sql("group_id = 'default' AND source = 'desk-client'"),
        "vector_min_similarity": _vector_sql(least="WHERE sim >= 0.25"),
        "vector_tag_boost": _vector_sql(boost=f"0.5 * {_RATIO}"),
        "keyword_bm25": _keyword_sql(),
        "keyword_filtered": _keyword_sql("group_id = 'default' AND list_contains(tags, 'docs')"),
        "keyword_tag_boost": _keyword_sql(boost=f"1.0 * {_RATIO}"),
        "keyword_ilike_fallback": _newest_sql("(content ILIKE '%451%' OR name ILIKE '%451%')", "1.0::DOUBLE", 20),
        "substring_search": _newest_sql("(content ILIKE '%-451%' OR name ILIKE '%-451%')", "1.0::DOUBLE", 20),
        "keyword_postings": f"WITH {_counts_sql(_TERMS)} SELECT id, round(bm, 6) AS score FROM b WHERE bm IS NOT NULL ORDER BY round(bm, 6) DESC, id LIMIT 50",
        "hybrid_default": _hybrid_sql(0.7),
        "hybrid_alpha": _hybrid_sql(0.3, "true"),
        "hybrid_no_embedding": _keyword_sql(),
        "hybrid_tag_boost": _hybrid_sql(0.7, boost=f"0.5 * {_RATIO}"),
        "count_live": f"SELECT count(DISTINCT id) AS n FROM episodes WHERE {_LIVE}",
        "count_stale": f"SELECT count(DISTINCT id) AS n FROM episodes WHERE {stale}",
        "count_force": f"SELECT count(DISTINCT id) AS n FROM episodes WHERE {_LIVE}",
        "stale_list": f"SELECT DISTINCT id FROM episodes WHERE {stale}",
        "reembed_page": f"SELECT DISTINCT id, length(content) AS chars FROM episodes WHERE {stale} AND id > '8' ORDER BY id LIMIT 64",
        "mutation_log_fold": f"""WITH {_E}, u AS (SELECT DISTINCT ON (update_id) * FROM episode_updates), f AS (SELECT episode_id, {last}, count(*) AS updates FROM u GROUP BY episode_id)
SELECT e.id, array_to_string(list_transform(coalesce(f.tags, e.tags), lambda x: coalesce(x, '-')), ',') AS tags, epoch_us(coalesce(f.expired_at, e.expired_at)) AS expired_us,
coalesce(f.metadata, e.metadata) AS metadata, coalesce(f.source, e.source) AS source, updates FROM e JOIN f ON e.id = f.episode_id""",
        "request_validation": """SELECT DISTINCT ON (request_id) request_id, coalesce(nullif(search_mode, ''), 'vector') IN ('vector', 'keyword', 'hybrid') AND coalesce(alpha, 0) >= 0 AND coalesce(alpha, 0) <= 1 AS valid,
coalesce(nullif(search_mode, ''), 'vector') AS mode, CASE WHEN request_profile = 'rest' AND coalesce(group_id, '') = '' THEN 'default' ELSE coalesce(group_id, '') END AS group_id,
CASE WHEN max_results > 0 THEN max_results ELSE 10 END AS max_results, CASE WHEN coalesce(alpha, 0) = 0 THEN 0.7 ELSE alpha END AS alpha FROM search_requests""",
        "reembed_status": "WITH r AS (SELECT DISTINCT ON (run_id) * FROM reembed_runs) SELECT embedding_model, count(*) AS runs, sum((finished_at IS NULL)::INT)::BIGINT AS running, sum((error_text IS NOT NULL)::INT)::BIGINT AS with_error, sum(done_rows)::BIGINT AS done_rows, sum(failed_rows)::BIGINT AS failed_rows, max(total_rows) AS largest FROM r GROUP BY embedding_model",
    }
