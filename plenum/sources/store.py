"""Tables that the engine writes for itself (stored columns, indexes), in the shared folder of the session.

A table is made once for an application and a state of its source; when the source's files change, it is made anew.
``clean`` removes all that this application has written; results that read it must have been written before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from plenum.session import shared_dir

_made: dict[tuple, str] = {}


def _status(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """When a file or folder last changed, its bytes and its files: asked of the store, nothing is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(where)
    return fs.getFileStatus(where).getModificationTime(), summary.getLength(), summary.getFileCount()


def _own(spark: SparkSession) -> str | None:
    folder = shared_dir(spark)
    return folder and f"{folder}/plenum-search/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    folder = _own(spark)
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def once(spark: SparkSession, name: str, sources: list[str], write: Callable[[str], object]) -> str:
    """The folder that ``write(folder)`` has filled from these source tables."""
    key = (spark.sparkContext.applicationId, name, *((s, *_status(spark, s)) for s in sources))
    if key not in _made:
        path = fresh(spark, name)
        write(path)
        _made[key] = path
    return _made[key]


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    folder = _own(spark)
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
    if folder is not None:
        remove(spark, folder)
