"""Tables of requests, updates and runs, handled a column at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .params import DEFAULT_ALPHA, DEFAULT_RESULTS, MODES


def checked_requests(requests: DataFrame) -> DataFrame:
    """(request_id, valid, mode, group_id, max_results, alpha): each request once, with the defaults of its entrance."""
    r = requests.dropDuplicates(["request_id"])
    mode = F.coalesce(F.nullif("search_mode", F.lit("")), F.lit("vector"))
    alpha = F.coalesce("alpha", F.lit(0.0))
    group = F.coalesce("group_id", F.lit(""))
    return r.select(
        "request_id",
        (mode.isin(*MODES) & (alpha >= 0) & (alpha <= 1)).alias("valid"),
        mode.alias("mode"),
        F.when((F.col("request_profile") == "rest") & (group == ""), F.lit("default")).otherwise(group).alias("group_id"),
        F.when(F.col("max_results") > 0, F.col("max_results")).otherwise(DEFAULT_RESULTS).cast("int").alias("max_results"),
        F.when(alpha == 0, DEFAULT_ALPHA).otherwise(alpha).alias("alpha"),
    )


def folded_updates(updates: DataFrame) -> DataFrame:
    """(episode_id, tags, expired_at, metadata, source, updates): the last given value of each field, by request time, then update id.

    Everything is a partial aggregate, so an episode with very many updates is reduced before the shuffle.
    """
    u = updates.dropDuplicates(["update_id"])
    at = F.struct("requested_at", "update_id")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("tags", "expired_at", "metadata", "source")]
    return u.groupBy("episode_id").agg(*last, F.count("*").alias("updates"))


def with_updates(episodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Episodes with their folded updates laid over them; updates that name no episode change nothing."""
    f = folded_updates(updates).select(F.col("episode_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("tags", "expired_at", "metadata", "source")], "updates")
    joined = episodes.join(f, "id", "left")
    for c in ("tags", "expired_at", "metadata", "source"):
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined


def run_summary(runs: DataFrame) -> DataFrame:
    """For each model its runs, how many still run or failed, and the rows refreshed."""
    r = runs.dropDuplicates(["run_id"])
    return r.groupBy("embedding_model").agg(F.count("*").alias("runs"), F.sum(F.col("finished_at").isNull().cast("long")).alias("running"), F.sum(F.col("error_text").isNotNull().cast("long")).alias("with_error"), F.sum("done_rows").alias("done_rows"), F.sum("failed_rows").alias("failed_rows"), F.max("total_rows").alias("largest"))
