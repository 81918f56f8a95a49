"""Tables that lie together by a key: bucketed alike, so that joins and groupings by the key need no exchange.

Two tables with the same number of buckets of the same key are joined bucket by bucket, and a table is grouped by its
key where it lies. The cost is one shuffle when a table is written. A bucket is one task's work, so the key should be
one of many with few rows each (a segment's sentences, an order's lines), and the number of buckets fit the largest
table. The tables are external ones in the session's catalog, below the given folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Buckets unless given.
BUCKETS = 32


def _name(path: str) -> str:
    return "plenum_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])


def write(rows: DataFrame, path: str, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """Write ``rows`` into ``path``, bucketed by ``key`` and sorted by it and ``order``; a file for each bucket."""
    placed = rows.repartition(buckets, key).sortWithinPartitions(key, *order)
    placed.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(_name(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_name(path))


def forget(spark: SparkSession, path: str) -> None:
    """Take the table out of the catalog; its files stay until their folder is removed."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
