"""From scores to relevance: min-max scaling over the filtered set, blending, tag boost and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_range(df: DataFrame, *scores: str) -> DataFrame:
    """Every row beside the minimum and maximum of its scores over all rows (one row, so broadcast)."""
    stats = df.agg(*[f(s).alias(f"{s}_{n}") for s in scores for n, f in (("min", F.min), ("max", F.max))])
    return df.crossJoin(F.broadcast(stats))


def scaled(score: str, flat: Column | float = 1.0) -> Column:
    """The score on [0, 1]; ``flat`` where all scores are equal; null stays null."""
    lo, hi, s = F.col(f"{score}_min"), F.col(f"{score}_max"), F.col(score)
    flat = flat if isinstance(flat, Column) else F.lit(float(flat))
    return F.when(s.isNull(), None).when(lo == hi, flat).otherwise(F.try_divide(s - lo, hi - lo))


def top(df: DataFrame, k: int, by: str = "relevance") -> DataFrame:
    """The k rows with the highest ``by``, nulls last, ties by id."""
    return df.orderBy(F.desc_nulls_last(by), "id").limit(k)
