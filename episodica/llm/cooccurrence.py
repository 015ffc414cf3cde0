"""Problem 6: items that appear together more often than chance, by stripes.

Per task each item gathers an associative array of the items beside it (its stripe, itself counted
too, which gives the single counts); stripes are sent by item and by a part of the neighbours, so
neither an item that stands in every record nor a large vocabulary meets in one task, and merged.
Pairs are then measured by lift and by Dunning's log-likelihood ratio.

Defined results: a record is a distinct non-null id; items are trimmed and lower-cased, null and
empty ones dropped, each counted once a record; records without an item left do not count towards n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import durable

_SPACE = " \t\n\r\f\v"
_HELD = 1 << 20
_PAIRS = 1 << 21
_SALTS = 16
_STRIPE = "item string, salt int, others array<string>, counts array<long>"


def baskets(df: DataFrame, id_col: str = "id", items_col: str = "tags") -> DataFrame:
    """(id, items): the distinct cleaned items of each record that has any."""
    clean = F.array_distinct(F.filter(F.transform(F.col(items_col), lambda x: F.lower(F.btrim(x, F.lit(_SPACE)))), lambda x: x.isNotNull() & (x != "")))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), clean.alias("items")).where(F.size("items") > 0)
    return rows.groupBy("id").agg(F.first("items").alias("items"))


def _pairs(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ordered pairs within baskets, itself included, in blocks of bounded size."""
    starts = np.cumsum(sizes) - sizes
    for m in np.unique(sizes):
        first = starts[sizes == m]
        for k in range(0, len(first), max(1, _PAIRS // int(m * m))):
            rows = codes[first[k : k + max(1, _PAIRS // int(m * m)), None] + np.arange(m)]
            step = max(1, _PAIRS // int(m))
            for j in range(0, int(m), step):
                left = rows[:, j : j + step]
                yield np.repeat(left.ravel(), m), np.repeat(rows[:, None, :], left.shape[1], axis=1).ravel()


def _emit(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    import xxhash

    out: tuple[list, list, list, list] = ([], [], [], [])
    for item, stripe in held.items():
        parts: dict[int, list[str]] = {}
        for other in stripe:
            parts.setdefault(xxhash.xxh3_64_intdigest(other) % _SALTS, []).append(other)
        for salt, others in parts.items():
            for z, value in zip(out, (item, salt, others, [stripe[o] for o in others])):
                z.append(value)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.int64()))], names=["item", "salt", "others", "counts"])


def stripes(records: DataFrame) -> DataFrame:
    """(item, salt, others, counts): the merged stripe of every item, in parts by neighbour."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        size = 0
        for b in batches:
            column = b.column("items")
            sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            for left, right in _pairs(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes):
                both, count = np.unique(left * len(names) + right, return_counts=True)
                for p, c in zip(both.tolist(), count.tolist()):
                    stripe = held.setdefault(names[p // len(names)], {})
                    other = names[p % len(names)]
                    if other not in stripe:
                        size += 1
                    stripe[other] = stripe.get(other, 0) + c
                if size > _HELD:
                    yield from _emit(held)
                    held, size = {}, 0
        yield from _emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stripe = None, {}
        for b in batches:
            for item, salt, others, counts in zip(*(c.to_pylist() for c in b.columns)):
                if (item, salt) != now:
                    if now:
                        yield _stripe_row(now, stripe)
                    now, stripe = (item, salt), {}
                for o, c in zip(others, counts):
                    stripe[o] = stripe.get(o, 0) + c
        if now:
            yield _stripe_row(now, stripe)

    return records.mapInArrow(gather, _STRIPE).repartition("item", "salt").sortWithinPartitions("item", "salt").mapInArrow(merge, _STRIPE)


def _stripe_row(key: tuple[str, int], stripe: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([list(stripe)], pa.list_(pa.string())), pa.array([list(stripe.values())], pa.list_(pa.int64()))], names=["item", "salt", "others", "counts"])


def _entropy(*cells: Column) -> Column:
    """Sum of k ln k over the cells, zero cells counting 0."""
    out = F.lit(0.0)
    for k in cells:
        out = out + F.when(k > 0, k * F.log(k)).otherwise(0.0)
    return out


def associations(df: DataFrame, *, id_col: str = "id", items_col: str = "tags") -> DataFrame:
    """(item_a, item_b, ab, a, b, n, lift, llr) for every pair seen together, item_a < item_b."""
    records = durable(baskets(df, id_col, items_col), "baskets")
    n = F.lit(float(records.count()))
    counts = durable(stripes(records).select(F.col("item").alias("x"), F.explode(F.arrays_zip("others", "counts")).alias("z")).select("x", F.col("z.others").alias("y"), F.col("z.counts").alias("c")).where("x <= y"), "stripes")
    single = counts.where("x = y").select("x", "c")
    pairs = counts.where("x < y").select(F.col("x").alias("item_a"), F.col("y").alias("item_b"), F.col("c").alias("ab"))
    full = pairs.join(single.select(F.col("x").alias("item_a"), F.col("c").alias("a")), "item_a").join(single.select(F.col("x").alias("item_b"), F.col("c").alias("b")), "item_b")
    ab, a, b = (F.col(c).cast("double") for c in ("ab", "a", "b"))
    llr = 2 * (_entropy(ab, a - ab, b - ab, n - a - b + ab) - _entropy(a, n - a) - _entropy(b, n - b) + _entropy(n))
    return full.select("item_a", "item_b", "ab", "a", "b", n.cast("long").alias("n"), (ab * n / (a * b)).alias("lift"), F.greatest(llr, F.lit(0.0)).alias("llr"))
