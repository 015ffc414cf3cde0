"""Problem 1: records that share most of their word sequences, by a grouped prefix join.

Every record becomes the set of its distinct k-word shingles. Tokens are ranked by a global order
(approximate corpus frequency first, rare before common), so two sets with Jaccard similarity >= t
must share a token among the first few of each. Records of one scope with the same set are one
*class*; classes with the same prefix and size are one *prefix group*. Only prefix groups are joined
on prefix tokens, with size filters; their classes are then expanded and verified on whole sets, so
the result is exact. Copies cost one row each: they are joined to their class at the end.

Defined results: rows with a null id, scope or text, and texts with fewer than ``min_words`` words,
have no partner; rows that repeat an id are one record; an empty table gives no rows; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import durable, spread
from . import kernels
from .sketches import bloom, fixed_array

SKETCH = 1 << 20
_BITS = 512
_LOW48 = np.uint64((1 << 48) - 1)


def _shingle_sets(texts: list[str], k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the texts that are long enough, their numbers of distinct shingles, and the shingles end to end."""
    keep, counts, sets = [], [], []
    for a, b in kernels.chunks(texts):
        hashes, first, last = kernels.words(texts[a:b])
        n = last - first
        ok = np.flatnonzero(n >= max(min_words, k))
        if not len(ok):
            continue
        g = kernels.grams(hashes, k) >> np.uint64(16)
        per = n[ok] - k + 1
        doc = np.repeat(np.arange(len(ok)), per)
        tokens = g[np.repeat(first[ok], per) + kernels.grouped_positions(per)]
        order = np.lexsort((tokens, doc))
        doc, tokens = doc[order], tokens[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
        keep.append(ok + a)
        counts.append(np.bincount(doc[new], minlength=len(ok)))
        sets.append(tokens[new])
    if not keep:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(keep), np.concatenate(counts), np.concatenate(sets)


def _pack(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = kernels.binary_values(column, "V6")
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw.tobytes(), np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel(), offsets


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SKETCH - 1)).astype(np.int64)


def _parity(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bitmap for each set in which every token flips one bit.

    Where two sets differ in d tokens their bitmaps differ in at most d bits, so half of what the
    sizes exceed the differing bits by bounds the overlap from above (exact bitmap filtering).
    """
    out = np.zeros((len(n), _BITS), bool)
    spot = (kernels.mix(tokens ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(_BITS - 1)).astype(np.int64)
    cell, times = np.unique(np.repeat(np.arange(len(n)), n) * _BITS + spot, return_counts=True)
    out.ravel()[cell[times % 2 == 1]] = True
    return np.packbits(out, axis=1)


def _ceil(x: Fraction, n: np.ndarray) -> np.ndarray:
    return -(-n * x.numerator // x.denominator)


class NearDuplicates:
    """The stages of the join over one table; ``class_pairs`` has the verified links between different sets."""

    def __init__(self, df: DataFrame, *, id_col: str = "id", text_col: str = "content", scope_col: str | None = "group_id", shingle: int = 5, threshold: str = "4/5", min_words: int = 0):
        self.t = Fraction(threshold)
        scope: Column = F.col(scope_col).cast("string") if scope_col else F.lit("")
        rows = df.select(F.col(id_col).alias("id"), scope.alias("scope"), F.col(text_col).alias("text")).where("id is not null and scope is not null and text is not null")
        self.rows = spread(rows)
        self.id_type = dict(rows.dtypes)["id"]
        self.k, self.min_words = shingle, min_words
        self._sets: DataFrame | None = None

    def sets(self) -> DataFrame:
        """(id, scope, scope_key, n, class, prefix_group, tokens); tokens are in rank order. One durable table."""
        if self._sets is not None:
            return self._sets
        k, least, t = self.k, self.min_words, self.t
        spark = self.rows.sparkSession

        def count(b: pa.RecordBatch, cells: np.ndarray) -> None:
            _, _, tokens = _shingle_sets(b.column(0).to_pylist(), k, least)
            cells += np.bincount(_cell(tokens), minlength=SKETCH).astype(cells.dtype)

        ranks = spark.sparkContext.broadcast(fixed_array(self.rows.select("text"), count, SKETCH, "int32", np.add))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, n, tokens = _shingle_sets(b.column("text").to_pylist(), k, least)
                if not len(keep):
                    continue
                doc = np.repeat(np.arange(len(keep)), n)
                order = np.lexsort((tokens, ranks.value[_cell(tokens)], doc))
                tokens = tokens[order]
                scope = kernels.string_hash(b.column("scope").take(pa.array(keep)).to_pylist())
                starts = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    whole = np.add.reduceat(kernels.mix(tokens), starts)
                    at = kernels.grouped_positions(n)
                    probe = n - _ceil(t, n) + 1
                    in_prefix = at < np.repeat(probe, n)
                    prefix = np.add.reduceat(np.where(in_prefix, kernels.mix(tokens ^ np.uint64(0x5BD1E995)), np.uint64(0)), starts)
                    salt = kernels.mix(scope + n.astype(np.uint64))
                    whole, prefix = kernels.mix(whole ^ salt), kernels.mix(prefix ^ salt)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(keep)), b.column("scope").take(pa.array(keep)), pa.array(scope.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(prefix.view(np.int64)), kernels.binary_column(_pack(tokens), n)],
                    names=["id", "scope", "scope_key", "n", "class", "prefix_group", "tokens"],
                )

        schema = f"id {self.id_type}, scope string, scope_key long, n int, class long, prefix_group long, tokens binary"
        self._sets = durable(self.rows.mapInArrow(build, schema), "shingle-sets")
        return self._sets

    def candidates(self) -> DataFrame:
        """(ga, gb): pairs of prefix groups of one scope that may be similar enough.

        Two sets whose prefixes share c tokens share at most c more than the longer rest allows: a
        token common to both that is in only one prefix ranks behind the end of the other prefix. So
        besides the sizes the number of shared prefix tokens is held against the overlap needed, and
        one of them must stand early enough in both sets.
        Both sides of the join are the same rows, so they are exchanged once.
        """
        t = self.t

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tokens, offsets = _unpack(b.column("prefix"))
                per = np.diff(offsets)
                n = b.column("n").to_numpy().astype(np.int64)
                scope = np.repeat(b.column("scope_key").to_numpy().view(np.uint64), per)
                key = kernels.mix(tokens ^ scope).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(b.column("prefix_group").to_numpy(), per)), pa.array(np.repeat(n << 31, per) | kernels.grouped_positions(per))], names=["key", "g", "at"])

        length = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator - F.lit(1e-9)).cast("int") + 1
        groups = self.sets().select("scope_key", "n", "prefix_group", F.substring("tokens", F.lit(1), length * 6).alias("prefix")).groupBy("scope_key", "n", "prefix_group").agg(F.first("prefix").alias("prefix"))
        rows = groups.mapInArrow(entries, "key long, g long, at long")

        def side(k: str) -> DataFrame:
            size, place = F.shiftright("at", 31).alias(f"n{k}"), F.col("at").bitwiseAND((1 << 31) - 1).alias(f"i{k}")
            return rows.select("key", F.col("g").alias(f"g{k}"), size, place)

        fits = (F.col("na") >= F.col("nb")) & (F.col("nb") * t.denominator >= F.col("na") * t.numerator) & ((F.col("na") > F.col("nb")) | (F.col("ga") > F.col("gb")))
        # n minus the prefix length is ceil(t n) - 1; the overlap needed is ceil(t / (1 + t) (na + nb)).
        rest = F.ceil(F.greatest("na", "nb") * t.numerator / t.denominator - F.lit(1e-9)) - 1
        need = F.ceil((F.col("na") + F.col("nb")) * t.numerator / (t.numerator + t.denominator) - F.lit(1e-9))
        # At least one shared token stands early enough in both for the overlap to be reached after it.
        early = (F.col("ia") <= F.col("na") - need) & (F.col("ib") <= F.col("nb") - need)
        shared = side("a").join(side("b"), "key").where(fits).select("ga", "gb", (need - rest).cast("int").alias("short"), early.alias("early")).where("early or short > 1")
        # The shortfall is the same in all rows of a pair: its rows are counted against it in one sum.
        return shared.groupBy("ga", "gb").agg((F.count("*") - F.max("short")).alias("spare"), F.max("early").alias("early")).where("spare >= 0 and early").select("ga", "gb")

    def class_pairs(self) -> DataFrame:
        """(ca, cb, na, nb, shared): verified pairs of different sets; one durable table."""
        t = self.t
        sets = self.sets()
        cand = durable(self.candidates(), "prefix-pairs")
        classes = sets.select("scope_key", "n", "class", "prefix_group", "id").groupBy("prefix_group", "class").agg(F.min("id").alias("id"))
        several = classes.groupBy("prefix_group").count().where("count > 1").select("prefix_group")
        needed = durable(cand.select(F.col("ga").alias("g")).union(cand.select(F.col("gb").alias("g"))).union(several.select(F.col("prefix_group").alias("g"))).distinct(), "prefix-needed")
        among = bloom(needed, "g", needed.count())

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = among(b.column("prefix_group").to_numpy())
                if hit.any():
                    yield b.filter(pa.array(hit))

        wanted = sets.select("id", "n", "class", "prefix_group", "tokens")
        # Rows of one class have equal sets; the copies are folded before the sets are moved.
        member = durable(wanted.mapInArrow(narrow, wanted.schema).groupBy("prefix_group", "class", "n").agg(F.first("tokens").alias("tokens")), "prefix-members")

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    bits = _parity(_unpack(b.column("tokens"))[0], b.column("n").to_numpy())
                    yield pa.RecordBatch.from_arrays([b.column("prefix_group"), b.column("class"), b.column("n"), kernels.binary_column(bits.ravel(), np.full(len(bits), _BITS // 8))], names=["g", "class", "n", "bits"])

        small = member.mapInArrow(mapped, "g long, class long, n int, bits binary")
        a = small.select(F.col("g").alias("ga"), F.col("class").alias("ca"), F.col("n").alias("na"), F.col("bits").alias("ba"))
        b = small.select(F.col("g").alias("gb"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
        across = a.join(cand, "ga").join(b, "gb").where((F.col("nb") * t.denominator >= F.col("na") * t.numerator) & (F.col("na") >= F.col("nb")))
        inside = a.join(b, (F.col("ga") == F.col("gb")) & (F.col("ca") > F.col("cb")))

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for z in batches:
                if not z.num_rows:
                    continue
                x, y = (kernels.binary_values(z.column(c), "u1")[0].reshape(-1, _BITS // 8) for c in ("ba", "bb"))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                n = z.column("na").to_numpy().astype(np.int64) + z.column("nb").to_numpy()
                most = (n - differ) // 2
                ok = pa.array(most * (t.numerator + t.denominator) >= n * t.numerator)
                yield pa.RecordBatch.from_arrays([z.column(c).filter(ok) for c in ("ca", "cb", "na", "nb")], names=["ca", "cb", "na", "nb"])

        pick = ["ca", "cb", "na", "nb", "ba", "bb"]
        likely = across.select(*pick).union(inside.select(*pick)).mapInArrow(possible, "ca long, cb long, na int, nb int")
        ta, tb = member.select(F.col("class").alias("ca"), F.col("tokens").alias("ta")), member.select(F.col("class").alias("cb"), F.col("tokens").alias("tb"))
        full = likely.join(ta, "ca").join(tb, "cb")
        cols = ["ca", "cb", "na", "nb", "ta", "tb"]

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                n = batch.num_rows
                ta, oa = _unpack(batch.column("ta"))
                tb, ob = _unpack(batch.column("tb"))
                row = np.concatenate([np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))])
                tok = np.concatenate([ta, tb])
                # A set holds no token twice, so a token that comes twice in a pair is in both sets.
                order = np.lexsort((tok, row))
                row, tok = row[order], tok[order]
                twice = (row[1:] == row[:-1]) & (tok[1:] == tok[:-1])
                shared = np.bincount(row[1:][twice], minlength=n)
                union = np.diff(oa) + np.diff(ob) - shared
                ok = shared * t.denominator >= union * t.numerator
                if ok.any():
                    keep = pa.array(ok)
                    yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("ca", "cb", "na", "nb")] + [pa.array(shared[ok].astype(np.int32))], names=["ca", "cb", "na", "nb", "shared"])

        pairs = full.select(*cols).mapInArrow(verify, "ca long, cb long, na int, nb int, shared int")
        return durable(pairs, "class-pairs")

    def members(self) -> DataFrame:
        """(id, scope, class), one row for each record."""
        return self.sets().select("id", "scope", "class").distinct()


def similar_pairs(df: DataFrame, **params) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records of one scope with similarity >= threshold, copies included."""
    op = NearDuplicates(df, **params)
    links = op.class_pairs()
    m = op.members()
    a, b = m.select(F.col("id").alias("x"), F.col("class").alias("ca")), m.select(F.col("id").alias("y"), F.col("class").alias("cb"))
    across = links.select("ca", "cb").join(a, "ca").join(b, "cb").select("x", "y")
    copied = m.groupBy("class").count().where("count > 1").select(F.col("class").alias("ca"))
    same = a.join(copied, "ca", "left_semi")
    within = same.join(same.select(F.col("x").alias("y"), F.col("ca").alias("cb")), F.col("ca") == F.col("cb")).where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_classes(df: DataFrame, **params) -> DataFrame:
    """(id, class_id, copies, links): each record with the smallest id of its class of equal sets,
    the size of that class and the number of other classes it is linked to."""
    op = NearDuplicates(df, **params)
    links = op.class_pairs()
    m = op.members()
    degree = links.select(F.col("ca").alias("class")).union(links.select(F.col("cb").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    classes = m.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return m.select("id", "class").join(classes.join(degree, "class", "left"), "class").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
