"""Finding stale embeddings and refreshing them in parallel."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedders import Embedder
from ..operators.filters import live, stale
from ..sources.store import EpisodeStore
from ..workspace import durable


@dataclass
class ReembedStatus:
    model: str
    total: int = 0
    done: int = 0
    failed: int = 0
    error: str = ""
    force: bool = False
    running: bool = False
    started: datetime | None = None
    finished: datetime | None = None


def targets(episodes: DataFrame, model: str, as_of: datetime, force: bool = False) -> DataFrame:
    """(id, content) of live episodes whose vector is missing or of another model; all live ones if forced."""
    rows = episodes.where(live(as_of))
    return (rows if force else rows.where(stale(model))).select("id", "content")


def page(rows: DataFrame, after: str = "", size: int = 64) -> DataFrame:
    """The next ``size`` rows by id after ``after``."""
    return rows.where(F.col("id") > after).orderBy("id").limit(size)


def embedded(rows: DataFrame, embedder: Embedder, dim: int) -> DataFrame:
    """(id, embedding, error) with one client for each task; a failed or wrong-sized vector gives an error text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["content"]):
                try:
                    v = embedder.generate(text or "")
                    out.append((i, v, None) if len(v) == dim else (i, None, f"length {len(v)}, wanted {dim}"))
                except Exception as e:  # noqa: BLE001 - a failed row is reported and tried again by a later run
                    out.append((i, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["id", "embedding", "error"])

    return rows.mapInPandas(run, "id string, embedding array<float>, error string")


def reembed(store: EpisodeStore, embedder: Embedder, dim: int, as_of: datetime, force: bool = False) -> ReembedStatus:
    """Refresh the store's vectors in one commit; failures stay stale."""
    probe = embedder.generate("probe")
    if len(probe) != dim:
        raise ValueError(f"the model gives vectors of length {len(probe)}, the store holds {dim}")
    got = durable(embedded(targets(store.episodes(), embedder.model, as_of, force), embedder, dim), "embedded")
    counts = got.agg(F.count("*").alias("total"), F.count("embedding").alias("done")).first()
    status = ReembedStatus(embedder.model, counts["total"], counts["done"], counts["total"] - counts["done"], force=force)
    if status.done:
        store.update_many(got.where("embedding is not null").select("id", "embedding", F.lit(embedder.model).alias("embedding_model")), ["embedding", "embedding_model"])
    return status


class ReembedJob:
    """One re-embedding at a time beside other work; a second start while one runs is refused."""

    def __init__(self, store: EpisodeStore, embedder: Embedder, dim: int):
        self.store, self.embedder, self.dim = store, embedder, dim
        self._state = ReembedStatus(embedder.model)
        self._lock = threading.Lock()
        self._thread: threading.Thread | None = None

    def status(self) -> ReembedStatus:
        with self._lock:
            return replace(self._state)

    def start(self, as_of: datetime, force: bool = False) -> ReembedStatus:
        """Probe the model, then start; RuntimeError if a job runs, ValueError if the model's vectors have another length."""
        probe = len(self.embedder.generate("probe"))
        if probe != self.dim:
            raise ValueError(f"the model gives vectors of length {probe}, the store holds {self.dim}")
        with self._lock:
            if self._state.running:
                raise RuntimeError("a re-embedding job is running")
            self._state = ReembedStatus(self.embedder.model, force=force, running=True, started=datetime.now(UTC))
            self._thread = threading.Thread(target=self._run, args=(as_of, force), daemon=True)
            self._thread.start()
            return replace(self._state)

    def wait(self, timeout: float | None = None) -> ReembedStatus:
        if self._thread is not None:
            self._thread.join(timeout)
        return self.status()

    def _run(self, as_of: datetime, force: bool) -> None:
        try:
            end = reembed(self.store, self.embedder, self.dim, as_of, force)
        except Exception as e:  # noqa: BLE001 - reported in the status
            end = ReembedStatus(self.embedder.model, force=force, error=str(e) or type(e).__name__)
        with self._lock:
            self._state = replace(end, started=self._state.started, finished=datetime.now(UTC))
