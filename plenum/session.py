"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def local_session(cpus: str = "*", name: str = "plenum") -> SparkSession:
    """A session for tests and small runs; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        return None
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="plenum-search-")
    return _own[spark.sparkContext.applicationId]


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever they run; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="plenum-code-"), "plenum.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("plenum", os.path.relpath(path, root)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
