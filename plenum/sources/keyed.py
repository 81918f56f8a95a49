"""Tables that are updated by key: rows in buckets of a key, and a manifest that says which files are the table.

A write puts whole buckets into a folder of its own and then publishes a manifest that names, for each bucket, the
folder that holds it. Buckets that a change does not touch keep their files. A manifest is published under the next
version number by a rename that fails if that number is taken, so a reader sees the table before or after a change,
and of two writers at once one must try again. Work that died before that left nothing that a reader sees.

Rows of one key are in one bucket, so a change by key reads and writes the buckets of its keys only. ``vacuum`` removes
folders that the newest manifest doesn't name. The manifest has a line for each bucket, whatever the table's size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from plenum.sources import documents

#: Buckets of a table unless given.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published a version since this one was read."""


class KeyedTable:
    """A table below ``path`` whose rows are bucketed by ``key`` (one column, such as a recording)."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark._jvm.org.apache.hadoop
        self._at = lambda p: jvm.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def version(self) -> int:
        """The newest version; 0 before the table is made."""
        if not self._fs.exists(self._at("manifest")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = version or self.version()
        if not version:
            raise FileNotFoundError(f"{self.path} holds no table")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{version:08d}.json", wholetext=True).collect()))

    def _publish(self, version: int, manifest: dict) -> None:
        draft = self._at(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        target = self._at(f"manifest/{version:08d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        held = {int(b): w for b, w in manifest["buckets"].items() if buckets is None or int(b) in buckets}
        if not held:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/write={w}/bucket={b}" for b, w in sorted(held.items())]
        kinds = StructType([*schema.fields, StructField("write", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(version))

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets that keys fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets alone."""
        keys = keys.select(self.key).distinct()
        return self._read(self._manifest(), self._touched(keys)).join(keys, self.key, "left_semi")

    # writing

    def _put(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket into a folder of their own; the buckets that came to be, with that folder."""
        write = uuid.uuid4().hex
        folder = f"{self.path}/data/write={write}"
        placed = rows.withColumn("bucket", self._bucket())
        placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(folder)
        made = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"data/write={write}"))]
        return {n.split("=")[1]: write for n in made if n.startswith("bucket=")}

    def create(self, rows: DataFrame) -> KeyedTable:
        self._publish(1, {"schema": rows.schema.jsonValue(), "buckets": self._put(rows)})
        return self

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """``change(rows)`` in place of the rows of the buckets that ``keys`` fall into; the new version."""
        version = self.version()
        manifest, touched = self._manifest(version), self._touched(keys)
        if not touched:
            return version
        new = change(self._read(manifest, touched))
        kept = {b: w for b, w in manifest["buckets"].items() if int(b) not in touched}
        self._publish(version + 1, {"schema": manifest["schema"], "buckets": kept | self._put(new.select(*StructType.fromJson(manifest["schema"]).names))})
        return version + 1

    def update(self, changes: DataFrame, on: list[str]) -> int:
        """Set the columns that ``changes`` has beside ``on`` (which holds the key) in the rows with equal ``on``, as
        UPDATE ... FROM does; null values are set too. Of several changes for a row the least counts. Rows without a
        change, and changes without a row, do nothing."""
        values = [c for c in changes.columns if c not in on]
        least = changes.groupBy(*on).agg(F.min(F.struct(*values)).alias("_new")).withColumn("_met", F.lit(True))

        def change(rows: DataFrame) -> DataFrame:
            met = rows.join(least, on, "left")
            kinds = dict(rows.dtypes)
            return met.withColumns({c: F.when(F.col("_met"), F.col("_new")[c].cast(kinds[c])).otherwise(F.col(c)) for c in values})

        return self._change(changes, change)

    def upsert(self, rows: DataFrame, keys: list[str], ignore: bool = False) -> int:
        """Put rows in by ``keys`` (which hold the key): they replace what is there, or with ``ignore`` give way."""
        return self._change(rows, lambda old: documents.upsert(old, rows, keys, ignore))

    def replace(self, rows: DataFrame, keys: DataFrame) -> int:
        """``rows`` in place of all rows of the given keys."""
        return self._change(keys, lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti").unionByName(rows))

    def vacuum(self) -> int:
        """Remove the folders that the newest version doesn't name and the older manifests; how many went."""
        version = self.version()
        live, gone = set(self._manifest(version)["buckets"].items()), 0
        for write in self._fs.listStatus(self._at("data")):
            name, left = write.getPath().getName(), 0
            for bucket in self._fs.listStatus(write.getPath()):
                number = bucket.getPath().getName()
                if number.startswith("bucket=") and (number.split("=")[1], name.split("=")[1]) not in live:
                    self._fs.delete(bucket.getPath(), True)
                    gone += 1
                else:
                    left += number.startswith("bucket=")
            if not left:
                self._fs.delete(write.getPath(), True)
        for f in self._fs.listStatus(self._at("manifest")):
            if f.getPath().getName() != f"{version:08d}.json":
                self._fs.delete(f.getPath(), False)
        return gone
