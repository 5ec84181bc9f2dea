"""Shared plumbing: scratch tables in the folder all executors see, Arrow maps, table reads."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_scopes: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_folder(spark)}/lodestar/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str, scoped: bool = True) -> str:
    """A new path in the shared folder; ``scoped`` paths go when the ``scratch_scope`` around them ends."""
    return "/".join([scratch_root(spark), *(_scopes if scoped else []), f"{label}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that ``materialize`` wrote; results that still read it become unusable."""
    _delete(spark, scratch_root(spark))


@contextmanager
def scratch_scope(spark: SparkSession, label: str):
    """Scratch tables written inside are deleted at the end; what is to stay must have been stored elsewhere."""
    _scopes.append(f"{label}-{uuid.uuid4().hex}")
    folder = "/".join([scratch_root(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        _delete(spark, folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, codec: str = "zstd", path: str | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy survives lost executors, and its size is known to the optimizer.  With ``drop_shuffles`` the write's
    shuffle files go when it ends, else when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if drop_shuffles else before)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Gives freed memory back to the system; a Python worker that is reused would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the columns of ``text_key``.
KEY = ["__k1", "__k2"]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; what depends on the text alone returns to its rows by them.

    Null counts as a text of its own.  Ids take no part, so null and repeated ids do no harm.
    """
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(1), text).alias(KEY[1])]


#: Largest table, in rows of one 8-byte id, that is sent to every executor.
BROADCAST_IDS = 4_000_000


def ids_if_small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (materialized, columns of 8 bytes), marked for broadcast only if its count is bounded.

    Keys of several columns take more memory as a hash table, so fewer of them are sent.
    """
    return F.broadcast(ids) if ids.count() <= limit // (4 if len(ids.columns) > 1 else 1) else ids
