"""The filter algebra of searches; each predicate is a Column, so scans get what they can push down."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def live(as_of: datetime) -> Column:
    """Not expired at ``as_of``; an expiry exactly then counts as expired."""
    return F.col("expired_at").isNull() | (F.col("expired_at") > F.lit(as_of))


def has_tags(tags: list[str]) -> Column:
    """Every one of ``tags`` is among the row's tags; rows without tags never are."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.array_contains("tags", t), F.lit(False)) for t in tags), F.lit(True))


def stale(model: str) -> Column:
    """Never embedded, or stamped with another model or none."""
    return F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))


def tag_ratio(tags: list[str]) -> Column:
    """Share of ``tags`` that the row carries, 0 for rows without tags."""
    if not tags:
        return F.lit(0.0)
    hits = reduce(lambda a, b: a + b, (F.coalesce(F.array_contains("tags", t), F.lit(False)).cast("int") for t in tags))
    return F.coalesce(F.when(F.col("tags").isNotNull(), hits / F.lit(float(len(tags)))), F.lit(0.0))


def predicates(p, as_of: datetime, need_vector: bool = False) -> list[Column]:
    """The predicates that a search's parameters call for."""
    out: list[Column] = []
    if need_vector:
        out.append(F.col("embedding").isNotNull())
    if p.group_id:
        out.append(F.col("group_id") == p.group_id)
    if p.before is not None:
        out.append(F.col("created_at") < F.lit(p.before))
    if p.after is not None:
        out.append(F.col("created_at") > F.lit(p.after))
    if not p.include_expired:
        out.append(live(as_of))
    if p.source:
        out.append(F.col("source") == p.source)
    if p.tags and p.tag_boost <= 0:
        out.append(has_tags(p.tags))
    return out
