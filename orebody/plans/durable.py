"""Intermediates that survive lost executors: written once to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    """A temporary folder that goes with this process."""
    path = tempfile.mkdtemp(prefix="orebody-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where nothing is configured and all is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found


#: What was written for each application and not removed yet.
_WRITTEN: dict[str, list[str]] = {}


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> None:
    """Have a written folder removed when the driver ends, or by clean()."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    found, store = _path(spark, path)
    store.deleteOnExit(found)


def written(spark: SparkSession) -> list[str]:
    """The intermediates of the application that are there now, in the order in which they were written."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove these intermediates; whatever reads them must be done."""
    app = spark.sparkContext.applicationId
    gone = set(paths) & set(written(spark))
    for path in gone:
        found, store = _path(spark, path)
        store.delete(found, True)
    if gone:
        _WRITTEN[app] = [p for p in _WRITTEN[app] if p not in gone]


def clean(spark: SparkSession) -> None:
    """Remove all intermediates of the application; results that were made from them must have been read by then."""
    remove(spark, written(spark))
    _WRITTEN.pop(spark.sparkContext.applicationId, None)


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back; cuts lineage, and nothing of it is on one executor alone."""
    path = f"{shared_dir(df.sparkSession)}/orebody/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    passing(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
