"""The named queries of the training-data operators and the SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_P1 = {"shingle": 3, "threshold": "3/5", "min_words": 20}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .near_duplicates import similar_pairs

    return similar_pairs(table(spark, d, "episodes"), **_P1)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    from .near_duplicates import similar_classes

    return similar_classes(table(spark, d, "episodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .personal import find

    return find(table(spark, d, "episodes"), table(spark, d, "name_parts"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .personal import redact

    return redact(table(spark, d, "episodes"), table(spark, d, "name_parts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .density import DensityClusters

    return DensityClusters(table(spark, d, "episodes")).linked()


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    from .density import DensityClusters

    return DensityClusters(table(spark, d, "episodes"), min_samples=5).clusters()[1]


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    from .density import DensityClusters

    return DensityClusters(table(spark, d, "episodes"), min_samples=5).clusters()[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import boundary_levels

    return boundary_levels(table(spark, d, "episodes"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import split_texts

    return split_texts(table(spark, d, "episodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .nn_descent import NeighbourGraph

    return NeighbourGraph(table(spark, d, "episodes"), least=0.975).exact_pairs(0.975).select("id_a", "id_b")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from .nn_descent import NeighbourGraph

    return NeighbourGraph(table(spark, d, "episodes"), delta=0.01).neighbours()


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    from .nn_descent import NeighbourGraph

    episodes = table(spark, d, "episodes")
    # The number that the last eight hexadecimal digits of the id state.
    asked = episodes.where(F.pmod(F.conv(F.right("id", F.lit(8)), 16, 10).cast("long"), F.lit(100)) == 0)
    return NeighbourGraph(episodes, delta=0.01).search(asked)


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    from .cooccurrence import associations

    r = associations(table(spark, d, "episodes"))
    return r.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "ab", "a", "b", "n", F.round("lift", 4).alias("lift"), F.round("llr", 3).alias("llr"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .cooccurrence import associations

    r = associations(table(spark, d, "episodes"))
    kept = r.where((F.col("ab") >= 8) & (F.col("ab") * 1000 >= F.col("n")) & (F.col("ab") * F.col("n") >= 3 * F.col("a") * F.col("b")))
    return kept.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack, token_lengths

    r = pack(token_lengths(table(spark, d, "documents")))
    return r.select(F.col("id").alias("doc_id"), "piece", "start", "tokens", "container")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .leakage import leaked

    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from .spam_pages import stuffed_pages

    return stuffed_pages(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_RUNS = "unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')))"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_BASKETS = f"""b AS (SELECT DISTINCT ON (id) id, list_distinct(list_filter(list_transform(tags, lambda x: lower(trim(x, {_BLANK}))), lambda x: x IS NOT NULL AND x <> '')) AS t FROM episodes WHERE id IS NOT NULL),
c AS (SELECT id, unnest(t) AS tag FROM b), n AS (SELECT count(DISTINCT id) AS n FROM c), s AS (SELECT tag, count(*) AS k FROM c GROUP BY tag),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS ab FROM c x JOIN c y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL),
m AS (SELECT tag_a, tag_b, ab, sa.k AS a, sb.k AS b, n FROM p JOIN s sa ON sa.tag = tag_a JOIN s sb ON sb.tag = tag_b, n)"""


def _xlogx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END)"


def oracle_sql() -> dict[str, str]:
    longest = "list_max(list_transform({}, lambda x: length(trim(x, chr(32) || chr(9) || chr(10) || chr(13)))))"
    paragraphs = longest.format("string_split_regex(content, '\\n[ \\t\\r]*\\n')")
    sentences = longest.format("string_split_regex(regexp_replace(content, '([.!?])[ \\t\\r]', '\\1' || chr(10), 'g'), '\\n')")
    words = longest.format("string_split_regex(content, '[ \\t\\r\\n]+')")
    gain = " + ".join(_xlogx(x) for x in ("ab", "a - ab", "b - ab", "n - a - b + ab", "n"))
    loss = " - ".join(_xlogx(x) for x in ("a", "n - a", "b", "n - b"))
    return {
        "p4_found": f"WITH e AS (SELECT DISTINCT ON (id) id, content FROM episodes WHERE id IS NOT NULL AND length(content) > 2000) SELECT id, CASE WHEN {paragraphs} <= 2000 THEN 'paragraph' WHEN {sentences} <= 2000 THEN 'sentence' WHEN {words} <= 2000 THEN 'word' ELSE 'none' END AS boundary FROM e",
        "p6_found": f"WITH {_BASKETS} SELECT tag_a, tag_b FROM m WHERE ab >= 8 AND ab * 1000 >= n AND ab * n >= 3 * a * b",
        "p6_pairs": f"WITH {_BASKETS} SELECT tag_a, tag_b, ab, a, b, n, round(ab * n / (a * b)::DOUBLE, 4) AS lift, round(greatest(0, 2 * ({gain} - {loss})), 3) AS llr FROM m",
        "p8_found": f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items), x AS (SELECT doc_id, {_RUNS} AS r FROM d WHERE len(w) >= 13), y AS (SELECT item_id, {_RUNS} AS r FROM i WHERE len(w) >= 13) SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (r)",
    }
