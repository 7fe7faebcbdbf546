"""Intermediate tables in the folder that the cluster shares.

A written table cuts the lineage: a lost executor costs the tasks it was
running, and nothing is recomputed from a machine-local copy.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where nobody else has to read it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it; gone when the driver ends, or before by ``forget``."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing lazy reads any more."""
    for df in frames:
        _delete(df._scratch)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # the JVM may be gone already
            return


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, jobs send at most ``rows`` rows a batch to Python; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
