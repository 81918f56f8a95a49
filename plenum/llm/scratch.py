"""Shared intermediate storage: the folder that the cluster names in ``spark.checkpoint.dir``.

What an operator leaves there for its lazy result is needed until that result has been written; ``clean`` removes
everything this application has left. Tables that only an operator itself needs are removed by it as it goes.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the cluster names none, a local master gets one of its own; any other is an error,
    because a folder on each machine's own disk would lose rows."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plenum-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plenum/{spark.sparkContext.applicationId}"


#: Rows of an Arrow batch, where the session names no number: batches are held by the JVM and by the worker, and texts
#: are long (Spark's 10,000 rows of 3 KB are 30 MB in each place, and the buffers that grow to them several times that).
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows from now on, unless the session's settings give a number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Remove all that this application's operators have left; their results must have been written before."""
    remove(spark, _own_dir(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages neither recompute it nor
    depend on the executors that made it."""
    return Scratch(df.sparkSession, name).keep(df, "rows")


class Scratch:
    """The intermediate tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, fresh_path(spark, name), []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self.made)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that ``keep`` has returned and that nothing reads any more."""
        for df, path in self.made:
            if any(df is f for f in frames):
                remove(self.spark, path)

    def drop_others(self, *frames: DataFrame) -> None:
        self.drop(*(df for df, _ in self.made if not any(df is f for f in frames)))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
