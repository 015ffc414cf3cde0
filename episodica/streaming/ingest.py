"""Streaming ingestion into a store (an extension): each micro-batch is one commit of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import EpisodeStore


def ingest(stream: DataFrame, store: EpisodeStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of episodes. A batch that is tried again puts the same ids again, which the fold makes one."""
    writer = stream.writeStream.foreachBatch(lambda rows, _: store.append(rows) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
