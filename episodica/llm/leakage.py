"""Problem 8: passages of test items inside a corpus, by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``run`` words of the items. A text is a sequence of word hashes; a
cursor looks at the block of two words that ends at it. The block table tells how far the cursor may
jump: ``run - 1`` words when no pattern holds the block, else the distance of the block to the end
of the nearest pattern that does. Where that is 0, the suffix block selects the bucket of patterns,
and the words are compared one by one. Texts are cut into segments that overlap by ``run - 1``
words, and the cursors of all segments of a batch advance side by side, so long texts cost no more.

Only the patterns are broadcast; they are searched in as many passes as keep a pass below
``pass_words`` words, so their size is bounded whatever the number of items.

Defined results: null ids and null texts give no rows; an item with fewer than ``run`` words has no
run and is never found; repeated rows give one result row; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import spread
from . import kernels

_SEGMENT = 256
_TABLE = 1 << 20


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        return x ^ (x >> np.uint64(31))


class Patterns:
    """Shift table, suffix buckets and words of all runs of the given items."""

    def __init__(self, items: list[tuple[object, str]], run: int):
        hashes, first, last = kernels.words([t for _, t in items])
        per = np.maximum(last - first - run + 1, 0)
        which = np.repeat(np.arange(len(items)), per)
        at = np.repeat(first, per) + kernels.grouped_positions(per)
        rows = hashes[at[:, None] + np.arange(run)] if len(at) else np.zeros((0, run), np.uint64)
        self.run = run
        self.shift = np.full(_TABLE, run - 1, np.uint8)
        for j in range(1, run):
            if len(rows):
                cell = (_block(rows[:, j - 1], rows[:, j]) & np.uint64(_TABLE - 1)).astype(np.int64)
                np.minimum.at(self.shift, cell, run - 1 - j)
        suffix = _block(rows[:, -2], rows[:, -1]) if len(rows) else np.zeros(0, np.uint64)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.rows, self.item = suffix[order], rows[order], which[order]
        self.ids = [i for i, _ in items]

    def search(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text index, item index) of every text that holds a run; distinct."""
        run = self.run
        n = np.maximum(last - first - run + 1, 0)
        segs = -(-n // _SEGMENT)
        doc = np.repeat(np.arange(len(first)), segs)
        cursor = first[doc] + kernels.grouped_positions(segs) * _SEGMENT + run - 1
        stop = np.minimum(cursor + _SEGMENT, last[doc])
        found = []
        while len(cursor):
            block = _block(hashes[cursor - 1], hashes[cursor])
            shift = self.shift[(block & np.uint64(_TABLE - 1)).astype(np.int64)].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                lo = np.searchsorted(self.suffix, block[hit], "left")
                many = np.searchsorted(self.suffix, block[hit], "right") - lo
                row = np.repeat(lo, many) + kernels.grouped_positions(many)
                where = np.repeat(hit, many)
                for k in range(0, len(row), 1 << 16):
                    r, w = row[k : k + (1 << 16)], where[k : k + (1 << 16)]
                    same = (hashes[cursor[w][:, None] + np.arange(1 - run, 1)] == self.rows[r]).all(axis=1)
                    if same.any():
                        found.append(np.stack([doc[w[same]], self.item[r[same]]], axis=1))
            cursor = cursor + np.maximum(shift, 1)
            live = cursor < stop
            if not live.all():
                cursor, stop, doc = cursor[live], stop[live], doc[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def leaked(corpus: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "item_text", run: int = 13, pass_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): every corpus text that holds ``run`` consecutive words of an item."""
    spark = corpus.sparkSession
    texts = spread(corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null"))
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    size = wanted.agg(F.sum(F.length("item_text"))).first()[0] or 0
    passes = max(1, -(-int(size) // (4 * pass_words)))
    kinds = dict(texts.dtypes)["doc_id"], dict(wanted.dtypes)["item_id"]
    out = None
    for p in range(passes):
        rows = [(r[0], r[1]) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()]
        shared = spark.sparkContext.broadcast(Patterns(rows, run))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            ids = pa.array(patterns.ids, pa.int64() if kinds[1] == "bigint" else None)
            for b in batches:
                values = b.column("text").to_pylist()
                for k, e in kernels.chunks(values):
                    doc, item = patterns.search(*kernels.words(values[k:e]))
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc + k)), ids.take(pa.array(item))], names=["doc_id", "item_id"])

        part = texts.mapInArrow(scan, f"doc_id {kinds[0]}, item_id {kinds[1]}")
        out = part if out is None else out.union(part)
    return out.distinct()
