"""Shared helpers: the folder that all executors share, tables that cut lineage, schema handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}
#: Bytes of one Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset in local mode (tests), one temporary folder per application.

    On a cluster the setting is needed: no folder of the driver's would be seen by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _LOCAL_SHARED[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it: later stages don't depend on this one's executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.written_to = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes tables of table() that nothing reads any more, in whatever store they are."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for a shuffle that Spark can't split by itself: the session's number, or more where a task would get over each rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops the columns an operator is about to add, so that a clashing input column is replaced by the result."""
    return df.drop(*[n for n in names if n in df.columns])


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_BYTES, whatever the length of the texts.

    Spark reads the size when the plan runs, so it stays set in the session. A worker that has ended a task hands what it freed back to the system, so that idle workers don't keep it from others.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(bounded, schema)
