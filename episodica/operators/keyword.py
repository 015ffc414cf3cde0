"""BM25 over content and name; statistics come from all records, whatever the filters of a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def term_counts(episodes: DataFrame, terms: list[str], *keep: Column | str) -> DataFrame:
    """(*keep, n_terms, tf_0, tf_1, ...) for every row, in one pass over the text."""
    words = episodes.select(*keep, tokens(F.col("content"), F.col("name")).alias("_words"))
    def tf(term: str) -> Column:
        return F.size(F.filter("_words", lambda w: w == F.lit(term)))
    return words.select("*", F.size("_words").alias("n_terms"), *[tf(t).alias(f"tf_{i}") for i, t in enumerate(terms)]).drop("_words")


def corpus_stats(counts: DataFrame, n: int) -> DataFrame:
    """One row: records, mean length and each term's document frequency."""
    return counts.agg(F.count("*").alias("_n"), F.avg("n_terms").alias("_avg"), *[F.sum((F.col(f"tf_{i}") > 0).cast("int")).alias(f"_df_{i}") for i in range(n)])


def bm25(n: int) -> Column:
    """Okapi BM25 of a row of ``term_counts`` beside ``corpus_stats``; null where no term occurs."""
    def part(i: int) -> Column:
        tf, df = F.col(f"tf_{i}"), F.col(f"_df_{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("n_terms") / F.col("_avg")))
    hit = reduce(lambda a, b: a | b, (F.col(f"tf_{i}") > 0 for i in range(n)), F.lit(False))
    return F.when(hit, reduce(lambda a, b: a + b, (part(i) for i in range(n)), F.lit(0.0)))


def postings(episodes: DataFrame) -> DataFrame:
    """(term, id, tf, n_terms): the materialized index, for many searches over one snapshot."""
    words = episodes.select("id", tokens(F.col("content"), F.col("name")).alias("w")).dropDuplicates(["id"])
    flat = words.select("id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))
    return flat.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("n_terms").alias("n_terms"))


def bm25_from_postings(index: DataFrame, terms: list[str], records: int, average: float) -> DataFrame:
    """(id, score) of the records that hold any term, from the index and two numbers of the snapshot."""
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(records))
    tf = F.col("tf")
    score = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("n_terms") / F.lit(average)))
    # One row for each query term.
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(score).alias("score"))
