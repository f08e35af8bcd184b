"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset a local session gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sedgeway-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: int | str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for the jobs run inside: each is held several times, in the JVM and in Python."""
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        yield


def owned(spark: SparkSession, path: str) -> None:
    """Note a folder that goes with the driver at last."""
    if not _kept:
        atexit.register(sweep)
    _kept[path] = spark


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back.  What isn't discarded before goes when the driver ends."""
    return written_to(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", partition_by)


def written_to(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """The same in a folder of the caller's choice."""
    spark = df.sparkSession
    owned(spark, path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # a table's shuffles go once it is written, not when the driver happens to collect its garbage
    with small_batches(spark), _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sedgeway_path = path  # type: ignore[attr-defined]
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing lazy refers to any more."""
    for df in tables:
        _delete(df.sparkSession, df._sedgeway_path)  # type: ignore[attr-defined]
        _kept.pop(df._sedgeway_path, None)  # type: ignore[attr-defined]


def sweep() -> None:
    """Delete every table that is left; only for when no result of theirs will be read any more."""
    for path in list(_kept):
        spark = _kept.pop(path)
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and a local folder with it
            return
