"""Helpers that shape multi-step plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests), one temporary folder for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="plan-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there. written_to is its path, for delete()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.written_to = path
    return again


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, folder: str) -> dict[int, str]:
    """Numbered subfolders (name=number) of a folder, in whatever store, that a writer has finished: by number, ascending."""
    place, store = _store(spark, folder)
    if not store.exists(place):
        return {}
    paths = [s.getPath() for s in store.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()]
    done = {int(p.getName().split("=")[1]): p.toString() for p in paths if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    return dict(sorted(done.items()))


def delete(spark: SparkSession, path: str) -> None:
    place, store = _store(spark, path)
    store.delete(place, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside and renamed; an existing one stays and is an error."""
    place, store = _store(spark, path)
    beside, _ = _store(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(place) or not store.rename(beside, place):
        store.delete(beside, False)
        raise FileExistsError(path)


def lines_of(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file of put()."""
    place, store = _store(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none if there is no folder."""
    place, store = _store(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []
