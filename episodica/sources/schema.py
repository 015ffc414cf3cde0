"""Schema of the episode log."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns that reads return; the vector and its stamp are never returned.
EPISODE_COLS = ["id", "content", "name", "source", "source_model", "source_description", "group_id", "tags", "created_at", "valid_at", "expired_at", "metadata"]

EPISODES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_model", T.StringType()),
        T.StructField("source_description", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("valid_at", T.TimestampType()),
        T.StructField("expired_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)
