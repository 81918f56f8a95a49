"""Arriving documents as a stream: a source over listings, storage events, and pairs of transcript and diarized file.

The source's offset is a time. A batch lists what changed after the last one's offset; each folder below the root (a
station) is listed by a task of its own, so the driver lists the root only. A store may show a file later than its time
of change says, so a batch looks back ``look_back`` seconds; what has been seen is dropped by key within a watermark of
at least that long. Offsets and state are in the query's checkpoint, so a restart goes on where the last run ended.
"""

from __future__ import annotations

import datetime
import posixpath
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from plenum.functions import times
from plenum.sources import documents

FORMAT = "plenum_listing"
SCHEMA = "key string, kind string, changed timestamp, size long"
# The names that tell a document's kind.
KINDS = {"_transcript.json": "transcript", "_diarized.json": "diarized"}


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool, after: int, until: int):
        super().__init__(path)
        self.path, self.deep, self.after, self.until = path, deep, after, until


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self._root = options["path"]
        self._back = int(float(options.get("look_back", 0)) * 1e6)
        self._settle = int(float(options.get("settle", 0)) * 1e6)
        self._since = int(float(options.get("since", 0)) * 1e6)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self._root) if "://" in self._root or self._root.startswith("file:") else (fs.LocalFileSystem(), self._root)

    def initialOffset(self) -> dict:
        return {"until": self._since}

    def latestOffset(self) -> dict:
        """Now, less the time that a store may take to show a file."""
        return {"until": max(self._since, int(time.time() * 1e6) - self._settle)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        from pyarrow import fs

        store, root = self._store()
        after = start["until"] if start["until"] <= self._since else max(self._since, start["until"] - self._back)
        below = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Folder(root, False, after, end["until"]), *(Folder(x.path, True, after, end["until"]) for x in below if x.type == fs.FileType.Directory)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = self._store()
        for x in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True)):
            changed = (x.mtime_ns or 0) // 1000
            if x.type == fs.FileType.File and partition.after < changed <= partition.until:
                kind = next((k for end, k in KINDS.items() if x.base_name.endswith(end)), "other")
                yield posixpath.relpath(x.path, root), kind, datetime.datetime.fromtimestamp(changed / 1e6, datetime.UTC), x.size


class ListingSource(DataSource):
    """``spark.readStream.format("plenum_listing").load(path)``: options look_back, settle and since, in seconds."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str | StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def listed(spark: SparkSession, path: str, look_back: float = 3600, settle: float = 0, since: float = 0) -> DataFrame:
    """(key, kind, changed, size) of files below ``path`` as they arrive, each key once within the look-back."""
    spark.dataSource.register(ListingSource)
    rows = spark.readStream.format(FORMAT).option("look_back", look_back).option("settle", settle).option("since", since).load(path)
    return once(rows, look_back)


def once(rows: DataFrame, seconds: float, time_column: str = "changed") -> DataFrame:
    """Rows of a stream, each key once within so many seconds."""
    return rows.withWatermark(time_column, f"{max(1, round(seconds))} seconds").dropDuplicatesWithinWatermark(["key"])


def from_events(lines: DataFrame, body: str = "body", time_column: str = "changed", seconds: float = 3600, default_bucket: str | None = None) -> DataFrame:
    """Arrivals by storage events instead of listings: (key, kind, time, bucket); events without a key are dropped,
    and an event that a store sends again is dropped within ``seconds``."""
    found = documents.events(lines, body, default_bucket).where(F.col("key").isNotNull())
    return once(found.select("key", _kind(F.col("key")).alias("kind"), F.col(time_column), "bucket"), seconds, time_column)


def _kind(key: Column) -> Column:
    out = F.when(F.lit(False), "")
    for end, kind in KINDS.items():
        out = out.when(key.endswith(end), kind)
    return out.otherwise("other")


def paired(arrivals: DataFrame, wait: float = 24 * 3600, time_column: str = "changed", unpaired: bool = False) -> DataFrame:
    """(key, diarized_key, arrived, diarized): each transcript with its diarized document, whichever comes first, if
    they are at most ``wait`` seconds apart; each pair once. ``unpaired``: a transcript whose wait is over without one
    comes with nulls, which is what must be diarized again. State is the arrivals of the last ``wait`` seconds."""
    of = lambda kind: arrivals.where(F.col("kind") == kind)
    left = of("transcript").select("key", F.col(time_column).alias("arrived"), times.diarized_key(F.col("key")).alias("_wanted"))
    right = of("diarized").select(F.col("key").alias("diarized_key"), F.col(time_column).alias("diarized"))
    apart = F.expr(f"INTERVAL {max(1, round(wait))} SECONDS")
    near = (F.col("diarized") >= F.col("arrived") - apart) & (F.col("diarized") <= F.col("arrived") + apart)
    met = left.join(right, (F.col("_wanted") == F.col("diarized_key")) & near, "leftOuter" if unpaired else "inner")
    return met.drop("_wanted")
