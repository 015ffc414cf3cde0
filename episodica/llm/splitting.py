"""Problem 4: cutting oversized texts at natural boundaries, range by range.

A text is handled in ranges of fixed size, each read with a halo on both sides. Stage 1 detects the
boundaries of each range: a run of white space is a paragraph break if it holds two or more line
feeds, a sentence break if it holds one or follows ``.``, ``!`` or ``?``, else a word break. Stage 2
stitches the ranges' boundary tables (units that lie across ranges are joined) and sums lengths into
offsets. Stage 3 emits pieces: every range starts at its first natural boundary, which its
predecessor finds in its halo too, so ranges are cut independently and pieces carry offsets in the
whole text. ``split_files`` reads byte ranges of files, so no file is ever loaded whole;
``split_texts`` does the same over a text column.

Defined results: null ids and null texts give no rows; a text within the limit is no case for
``boundary_levels`` and one piece for ``split_texts`` (an empty one none); rows that repeat an id
are one record; characters are Unicode code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import spread

_LEVELS = ("paragraph", "sentence", "word")
_RANGE = 1 << 16
_TABLE = "part int, chars long, empty boolean, lead int, trail int, stops boolean, first array<long>, last array<long>, inner array<long>, breaks array<boolean>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts and ends of the words, line feeds before each word, whether each ends in a stop, and line feeds after the last."""
    space = (c == 32) | (c == 9) | (c == 13) | (c == 10)
    edge = np.flatnonzero(np.diff((~space).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    feeds = np.concatenate([[0], np.cumsum(c == 10)])
    if not len(start):
        return start, end, np.zeros(0, np.int64), np.zeros(0, bool), int(feeds[-1])
    before = feeds[start] - feeds[np.concatenate([[0], end[:-1]])]
    final = c[end - 1]
    return start, end, before, (final == 46) | (final == 33) | (final == 63), int(feeds[-1] - feeds[end[-1]])


def boundary_table(text: str, part: int = 0) -> dict:
    """What a range contributes to its text: its length, the white space at its ends, and for each
    level the extent of its first and last unit (offsets in the range) and its longest unit between."""
    c = _codes(text)
    start, end, feeds, stop, trail = _runs(c)
    row = {"part": part, "chars": len(c), "empty": not len(start), "lead": 0, "trail": trail, "stops": False, "first": [], "last": [], "inner": [], "breaks": []}
    if not len(start):
        return row
    row |= {"lead": int(feeds[0]), "stops": bool(stop[-1])}
    for level in range(3):
        after = feeds[1:]
        cut = np.flatnonzero(after >= 2 if level == 0 else (after >= 1) | stop[:-1] if level == 1 else np.ones(len(after), bool)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]])
        units = np.stack([start[lo], end[hi - 1]], axis=1)
        row["first"] += [int(x) for x in units[0]]
        row["last"] += [int(x) for x in units[-1]]
        row["inner"].append(int((units[1:-1, 1] - units[1:-1, 0]).max()) if len(units) > 2 else 0)
        row["breaks"].append(len(units) > 1)
    return row


def stitch(rows: list[dict]) -> tuple[int, list[int]]:
    """Length of the text and its longest paragraph, sentence and word, from its ranges' tables in order."""
    offset, longest = 0, [0, 0, 0]
    open_unit: list[tuple[int, int] | None] = [None, None, None]
    feeds, stops, gap = 0, False, False
    for r in rows:
        if r["empty"]:
            feeds, gap = feeds + r["trail"], gap or r["chars"] > 0
            offset += r["chars"]
            continue
        touching = not gap and r["first"][0] == 0
        between = feeds + r["lead"]
        for k in range(3):
            lo, hi = r["first"][2 * k] + offset, r["first"][2 * k + 1] + offset
            if open_unit[k] is not None:
                parted = not touching and (between >= 2 if k == 0 else between >= 1 or stops if k == 1 else True)
                if parted:
                    longest[k] = max(longest[k], open_unit[k][1] - open_unit[k][0])
                else:
                    lo = open_unit[k][0]
            longest[k] = max(longest[k], r["inner"][k])
            if r["breaks"][k]:
                longest[k] = max(longest[k], hi - lo)
                open_unit[k] = (r["last"][2 * k] + offset, r["last"][2 * k + 1] + offset)
            else:
                open_unit[k] = (lo, hi)
        feeds, stops = r["trail"], r["stops"]
        offset += r["chars"]
        gap = r["last"][5] < r["chars"]
    return offset, [max(x, u[1] - u[0] if u else 0) for x, u in zip(longest, open_unit)]


def _cuts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after white-space runs where a piece may start, and the level of each (0 paragraph, 1 sentence, 2 word)."""
    start, _, feeds, stop, _ = _runs(c)
    if len(start) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    level = np.where(feeds[1:] >= 2, 0, np.where((feeds[1:] >= 1) | stop[:-1], 1, 2))
    return start[1:], level


def _best(at: np.ndarray, level: np.ndarray, lo: int, hi: int, last: bool) -> tuple[int, int] | None:
    """The last (or first) cut of the coarsest level with lo < offset <= hi."""
    i, j = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "right")
    if i >= j:
        return None
    best = int(level[i:j].min())
    found = np.flatnonzero(level[i:j] == best)
    return int(at[i + found[-1 if last else 0]]), best


def range_pieces(text: str, begin: int, end: int, offset: int, total: int, limit: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, stop, level) of the pieces of one range; ``text`` holds the range [begin, end) and its halos,
    ``offset`` is where ``text`` starts in the whole text of ``total`` characters."""
    c = _codes(text)
    at, level = _cuts(c)
    names = (*_LEVELS, "none")

    def opening(k: int) -> int:
        if k + offset <= 0:
            return -offset
        if k + offset >= total:
            return total - offset
        # Where the text begins in mid-range, the first boundary within a piece's length opens it.
        got = _best(at, level, k, min(k + limit, len(c)), False)
        return got[0] if got else k

    here, stop = opening(begin), opening(end)
    while here < stop:
        back = max(0, here - overlap) if here + offset > 0 else here
        if back < here:
            words = at[(at >= back) & (at < here)]
            back = int(words[0]) if len(words) else (here if len(at) and here in at else back)
        most = back + limit
        if stop <= most:
            cut, how = stop, 0
        else:
            cut, how = _best(at, level, here, min(most, len(c)), True) or (most, 3)
        yield back + offset, cut + offset, names[how]
        here = cut


def _ranges(b: pa.RecordBatch, size: int) -> Iterator[tuple[object, str, list[tuple[int, int]]]]:
    for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
        yield i, t, [(k, min(k + size, len(t))) for k in range(0, len(t), size)]


def boundary_levels(df: DataFrame, *, id_col: str = "id", text_col: str = "content", limit: int = 2000, range_chars: int = _RANGE) -> DataFrame:
    """(id, boundary) for every text of more than ``limit`` characters: the coarsest unit of which none is longer."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).where((F.length("text") > limit) & F.col("id").isNotNull())
    kind = dict(rows.dtypes)["id"]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tables = [], []
            for i, t, ranges in _ranges(b, range_chars):
                for k, (lo, hi) in enumerate(ranges):
                    ids.append(i)
                    tables.append(boundary_table(t[lo:hi], k))
            if ids:
                schema = pa.schema([("part", pa.int32()), ("chars", pa.int64()), ("empty", pa.bool_()), ("lead", pa.int32()), ("trail", pa.int32()), ("stops", pa.bool_())] + [(n, pa.list_(pa.int64())) for n in ("first", "last", "inner")] + [("breaks", pa.list_(pa.bool_()))])
                t = pa.RecordBatch.from_pylist(tables, schema)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), *t.columns], names=["id", *t.schema.names])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                _, longest = stitch(parts)
                out.append(next((name for name, n in zip(_LEVELS, longest) if n <= limit), "none"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "boundary"])

    fields = ["part", "chars", "empty", "lead", "trail", "stops", "first", "last", "inner", "breaks"]
    tables = rows.mapInArrow(detect, f"id {kind}, {_TABLE}").groupBy("id", "part").agg(F.first(F.struct(*fields)).alias("t"))
    # One row of fixed size for each range, so a text's tables stay small beside the text.
    return tables.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("parts")).mapInArrow(classify, f"id {kind}, boundary string")


def split_texts(df: DataFrame, *, id_col: str = "id", text_col: str = "content", limit: int = 2000, overlap: int = 150, range_chars: int = _RANGE) -> DataFrame:
    """(id, piece, start, length, boundary, text): ordered pieces of every text, each at most ``limit`` characters."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    kind = dict(rows.dtypes)["id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, t, ranges in _ranges(b, range_chars):
                if len(t) <= limit:
                    if t:
                        out.append((i, 0, len(t), "whole", t))
                    continue
                for lo, hi in ranges:
                    at = max(0, lo - overlap - limit)
                    part = t[at : hi + 2 * limit]
                    out.extend((i, s, e - s, how, t[s:e]) for s, e, how in range_pieces(part, lo - at, hi - at, at, len(t), limit, overlap))
            if out:
                ids, starts, lengths, hows, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("id").type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(hows), pa.array(texts, pa.string())], names=["id", "start", "length", "boundary", "text"])

    pieces = rows.mapInArrow(emit, f"id {kind}, start long, length int, boundary string, text string").dropDuplicates(["id", "start"])
    return pieces.withColumn("piece", F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1).select("id", "piece", "start", "length", "boundary", "text")


def split_files(spark: SparkSession, paths: list[str], *, limit: int = 2000, overlap: int = 150, range_bytes: int = 1 << 24) -> DataFrame:
    """(path, piece, start, length, boundary, text) of UTF-8 files in a folder that all executors share.

    Workers read byte ranges with halos. A first pass counts the characters of each range, a prefix
    sum turns byte ranges into character offsets, and a second pass cuts.
    """
    import os

    plan = [(p, k, lo, min(lo + range_bytes, n), n) for p in paths for n in [os.path.getsize(p)] for k, lo in enumerate(range(0, n, range_bytes))]
    ranges = spark.createDataFrame(plan, "path string, part int, lo long, hi long, size long").repartition(max(1, len(plan)))

    def aligned(data: bytes, k: int) -> int:
        while k < len(data) and data[k] & 0xC0 == 0x80:
            k += 1
        return k

    def read(path: str, lo: int, hi: int, size: int, halo: int) -> tuple[bytes, int, int]:
        """Bytes of the range with its halos, on code point borders, and where the range lies in them."""
        a, z = max(0, lo - halo), min(size, hi + halo + 4)
        with open(path, "rb") as f:
            f.seek(a)
            data = f.read(z - a)
        skip = aligned(data, 0) if a else 0
        begin, end = aligned(data, lo - a) if lo else 0, aligned(data, hi - a) if hi < size else len(data)
        while z < size and len(data) > end and data[-1] & 0xC0 == 0x80:
            data = data[:-1]
        if z < size and len(data) > end and data[-1] >= 0xC0:
            data = data[:-1]
        return data[skip:], begin - skip, end - skip

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars = []
            for r in b.to_pylist():
                data, begin, end = read(r["path"], r["lo"], r["hi"], r["size"], 0)
                chars.append(int((np.frombuffer(data[begin:end], np.uint8) & 0xC0 != 0x80).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chars, pa.int64())], names=[*b.schema.names, "chars"])

    halo = 4 * (2 * limit + overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, begin, end = read(r["path"], r["lo"], r["hi"], r["size"], halo)
                text = data.decode("utf-8", "replace")
                before = len(data[:begin].decode("utf-8", "replace"))
                inside = len(data[begin:end].decode("utf-8", "replace"))
                offset = r["offset"] - before
                out = [(r["path"], s, e - s, how, text[s - offset : e - offset]) for s, e, how in range_pieces(text, before, before + inside, offset, r["total"], limit, overlap)]
                if out:
                    path, starts, lengths, hows, texts = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(hows), pa.array(texts)], names=["path", "start", "length", "boundary", "text"])

    fields = "path string, part int, lo long, hi long, size long"
    counted = ranges.mapInArrow(count, f"{fields}, chars long")
    w = Window.partitionBy("path").orderBy("part")
    placed = counted.withColumn("offset", F.sum("chars").over(w) - F.col("chars")).withColumn("total", F.sum("chars").over(Window.partitionBy("path"))).drop("chars").repartition(max(1, len(plan)))
    pieces = placed.mapInArrow(cut, "path string, start long, length int, boundary string, text string")
    return pieces.withColumn("piece", F.row_number().over(Window.partitionBy("path").orderBy("start")) - 1).select("path", "piece", "start", "length", "boundary", "text")
