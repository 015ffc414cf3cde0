"""Durable intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: such a table survives the loss of
executors, is compressed and columnar, and carries statistics. The setting is read from the session;
a folder of our own is made only where it is unset and the session is a local one.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="episodica-")
    return "file://" + _local_dir[app]


def durable(df: DataFrame, tag: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/episodica/{tag}-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._episodica_path = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table made by ``durable`` that nothing reads any more."""
    path = getattr(table, "_episodica_path", None)
    if path:
        _delete(table.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def collect_garbage(table: DataFrame) -> None:
    """Let the session drop the shuffle files of plans that nothing holds any more."""
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def spread(df: DataFrame) -> DataFrame:
    """Give a table that arrives in fewer splits than there are cores one split a core.

    Only files too small to be split are affected, so what moves is bounded by cores x split size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
