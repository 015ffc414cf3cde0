"""An episode store as an append-only log of Parquet batches below one folder.

Every commit is one new batch folder and one marker file that makes it visible; readers see the
batches whose markers exist, so a failed write leaves nothing behind. The state is the fold of the
log by id: the last put, with later partial updates laid over it, unless a delete came after it.
``compact`` writes the fold as a new base, after which older batches are no longer read.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import live, stale
from ..plans.params import UpdateParams
from .schema import EPISODE_COLS, EPISODES

_UPDATABLE = ("tags", "expired_at", "metadata", "embedding", "embedding_model", "source")
_LOG = T.StructType([*EPISODES.fields, T.StructField("_version", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_set", T.ArrayType(T.StringType()))])


def fold(log: DataFrame) -> DataFrame:
    """The current episodes of a log: one shuffle by id, partial aggregates only, so an id with very many updates is reduced before it.

    An update counts only after the last put, and that put only after the last delete.
    """
    gone = F.max(F.when(F.col("_op") == "delete", F.col("_version"))).alias("_gone")
    put = F.when(F.col("_op") == "put", F.struct(*EPISODES.fieldNames()))
    at = F.when(F.col("_op") == "put", F.col("_version"))
    last_put = F.max_by(put, at).alias("_put")
    changes = []
    for c in _UPDATABLE:
        given = (F.col("_op") == "update") & F.array_contains("_set", c)
        # The version is kept beside the value, so that null values and values before the last put are told apart.
        changes.append(F.max_by(F.when(given, F.struct(F.col("_version").alias("v"), F.col(c).alias("x"))), F.when(given, F.col("_version"))).alias(f"_new_{c}"))
    state = log.groupBy("id").agg(last_put, F.max(at).alias("_at"), gone, *changes).where("_put is not null and (_gone is null or _at > _gone)")
    cols = []
    for name in EPISODES.fieldNames():
        value = F.col(f"_put.{name}")
        if name in _UPDATABLE:
            value = F.when(F.col(f"_new_{name}.v") > F.col("_at"), F.col(f"_new_{name}.x")).otherwise(value)
        cols.append(value.alias(name))
    return state.select(*cols)


class EpisodeStore:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        """Open the store at ``path``, which is made if absent. ``dim`` is the length vectors must have."""
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/commits"))

    def _commits(self) -> list[tuple[int, str]]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if n[:1].isdigit())

    @property
    def version(self) -> int:
        return max((v for v, _ in self._commits()), default=0)

    def _commit(self, rows: DataFrame, op: str, given: list[str], kind: str = "log") -> int:
        v = self.version + 1
        for f in EPISODES.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in EPISODES.fields], F.lit(v).cast("long").alias("_version"), F.lit(op).alias("_op"), F.array(*[F.lit(g) for g in given]).cast("array<string>").alias("_set"))
        out.write.mode("overwrite").parquet(f"{self.path}/batches/{v:010d}")
        # Creating the marker fails if another writer took the version; then nothing of this batch is visible.
        self._fs.create(self._path(f"{self.path}/commits/{v:010d}-{kind}"), False).close()
        return v

    def log(self) -> DataFrame:
        commits = self._commits()
        base = max((v for v, k in commits if k == "base"), default=0)
        paths = [f"{self.path}/batches/{v:010d}" for v, _ in commits if v >= base]
        return self.spark.read.schema(_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], _LOG)

    def episodes(self) -> DataFrame:
        return fold(self.log())

    def append(self, rows: DataFrame, as_of: datetime | None = None) -> int:
        """Add episodes with defaults for what is missing: a new id, the group ``default``, the time now; empty tags, vectors and metadata are null."""
        now = F.lit(as_of) if as_of else F.current_timestamp()
        have = set(rows.columns)
        def col(name: str):
            return F.col(name) if name in have else F.lit(None).cast(EPISODES[name].dataType)
        for required in ("content", "source"):
            if required not in have:
                raise ValueError(f"{required} is required")
        vector = F.when(F.size(col("embedding")) > 0, col("embedding"))
        if self.dim is not None:
            bad = F.raise_error(F.lit(f"a vector is not of length {self.dim}"))
            vector = F.when(F.size(vector) != self.dim, bad.cast(EPISODES["embedding"].dataType)).otherwise(vector)
        full = rows.select(
            F.coalesce(F.nullif(col("id"), F.lit("")), F.expr("uuid()")).alias("id"),
            F.when(F.col("content").isNull(), F.raise_error(F.lit("content is required")).cast("string")).otherwise(F.col("content")).alias("content"),
            F.when(F.col("source").isNull(), F.raise_error(F.lit("source is required")).cast("string")).otherwise(F.col("source")).alias("source"),
            *[F.coalesce(col(c), F.lit("")).alias(c) for c in ("name", "source_model", "source_description")],
            F.coalesce(F.nullif(col("group_id"), F.lit("")), F.lit("default")).alias("group_id"),
            F.when(F.size(col("tags")) > 0, col("tags")).alias("tags"),
            vector.alias("embedding"),
            F.when(F.size(col("embedding")) > 0, col("embedding_model")).alias("embedding_model"),
            F.coalesce(col("created_at"), now).alias("created_at"),
            col("valid_at").alias("valid_at"),
            col("expired_at").alias("expired_at"),
            F.nullif(col("metadata"), F.lit("")).alias("metadata"),
        )
        return self._commit(full, "put", [])

    def get(self, id: str) -> dict[str, Any]:
        """One episode without its vector; KeyError if there is none. The id is pushed to the scans of the log."""
        found = fold(self.log().where(F.col("id") == id)).select(*EPISODE_COLS).take(1)
        if not found:
            raise KeyError(id)
        return found[0].asDict(recursive=True)

    def update(self, id: str, params: UpdateParams) -> int:
        given = params.given()
        if not given:
            raise ValueError("nothing to update")
        self.get(id)
        row = {"id": id} | given
        schema = T.StructType([EPISODES[c] for c in row])
        return self._commit(self.spark.createDataFrame([tuple(row.values())], schema), "update", list(given))

    def update_many(self, rows: DataFrame, given: list[str]) -> int:
        """Lay the ``given`` columns of ``rows`` over the episodes of the same id."""
        return self._commit(rows, "update", given)

    def delete(self, id: str) -> int:
        self.get(id)
        return self._commit(self.spark.createDataFrame([(id,)], "id string"), "delete", [])

    def count(self, as_of: datetime) -> int:
        """Live episodes of all groups."""
        return self.episodes().where(live(as_of)).count()

    def count_stale(self, model: str, as_of: datetime, force: bool = False) -> int:
        rows = self.episodes().where(live(as_of))
        return (rows if force else rows.where(stale(model))).count()

    def compact(self) -> int:
        """Write the folded log as a new base."""
        return self._commit(self.episodes(), "put", [], kind="base")


def upgraded(rows: DataFrame) -> DataFrame:
    """A table of an older layout with today's columns: times with zone, the embedding stamp added if missing, retired columns left out."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EPISODES.fields])
