"""Shared scratch tables: a lineage cut that every executor can read and any lost executor survives."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_kept: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode, where it is unset."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lontar-")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{base_dir(spark)}/lontar-{tag}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_drop_all)
    _kept.add(path)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the eager actions inside; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most, for the eager actions inside, where rows are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def batch_bytes(spark: SparkSession, size: int):
    """Arrow batches that end with the row that takes them to so many bytes, for the eager actions inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, tag: str, group_bytes: int | None = None) -> DataFrame:
    """df written to the shared folder and read back; its path is in ``.lontar_path`` for drop().

    The write's shuffle files go with it, as nothing reads them again. group_bytes: where rows are of some MB each, the
    bytes after which a row group ends, looked at after each row and not after 100; a reader holds a row group's rows.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with setting(spark, _CLEANUP, "true"):
        small = {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1"} if group_bytes else {}
        df.select("*").write.options(compression="zstd", **small).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lontar_path = path
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for small intermediate tables."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base_dir(df.sparkSession))
    return df.checkpoint()


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no lazy plan reads any more."""
    for df in tables:
        _delete(df.lontar_path)
        _kept.discard(df.lontar_path)


def _delete(path: str) -> None:
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # the session may be gone at exit; the folder's owner clears the rest
            return
