"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: Column, query: list[float]) -> Column:
    """Cosine with ``query``; null where the vector is null, of another length, zero, or not finite."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    value = F.try_divide(_dot(vectors, q), F.sqrt(_dot(vectors, vectors)) * F.lit(norm))
    return F.when((F.size(vectors) == len(query)) & ~F.isnan(value), value)
