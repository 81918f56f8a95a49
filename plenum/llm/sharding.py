"""Placement on shards by a permutation-filled lookup table (Maglev hashing, Eisenbud et al. 2016).

Every shard has an order of preference over the slots of a table of prime size: offset + k * skip. Shards take turns,
each claiming the first slot on its list that is still free, until the table is full. A key belongs to the shard in
slot md5(key) mod size: one lookup, all shards even within one slot, and when a shard leaves, few other keys move.

The table depends on the shard names alone (its size is a parameter), so broadcasting it has a proven bound.
Placement is a DataFrame join and nothing else. Keys spread evenly whatever their source; a null key goes where the
empty string goes; repeated keys go to the same shard; an empty table gives no rows; extra columns are kept, and those
named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over a hundred times the number of shards keeps their shares within one percent.
SHARDS, TABLE_SIZE = 16, 2039


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def _md5(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. ``size`` must be prime, so that every shard's list visits every slot."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size:
        raise ValueError("shard names must be distinct, at least one and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    offset = [_md5(f"offset:{s}") % size for s in shards]
    skip = [_md5(f"skip:{s}") % (size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    turn, tried, slots = 0, [0] * len(shards), [""] * size
    for _ in range(size):
        i = turn % len(shards)
        while slots[at := (offset[i] + tried[i] * skip[i]) % size]:
            tried[i] += 1
        slots[at] = shards[i]
        turn += 1
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(hexed, 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with the columns slot and shard."""
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards or shard_names(), size))), "slot int, shard string")
    return rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot", "left")


def write_shards(rows: DataFrame, key: str, path: str, shards: list[str] | None = None, size: int = TABLE_SIZE) -> None:
    """Write ``rows`` under path/shard=... . Tasks write what they have; slots deal a shard's rows to several tasks, so
    that no shard is one task's work."""
    placed = place(rows, key, shards, size)
    placed.repartition("slot").drop("slot").write.partitionBy("shard").parquet(path)


#: DuckDB: one recursion step is one claim; ``taken`` holds the slots in the order of the claims.
PLACEMENT_SQL = f"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::varchar, 3, '0') AS name FROM range({SHARDS}) t(i)),
pref AS MATERIALIZED (
  SELECT i, name, ('0x' || substr(md5('offset:' || name), 1, 8))::bigint % {TABLE_SIZE} AS o,
         ('0x' || substr(md5('skip:' || name), 1, 8))::bigint % {TABLE_SIZE - 1} + 1 AS s FROM shard),
lists AS MATERIALIZED (
  SELECT list((SELECT list((o + k * s) % {TABLE_SIZE} ORDER BY k) FROM range({TABLE_SIZE}) t(k)) ORDER BY i) AS l FROM pref),
fill AS (
  SELECT 0 AS turn, (-1)::bigint AS slot, list_transform(range({TABLE_SIZE}), lambda x: false) AS used
  UNION ALL
  SELECT turn + 1, claim, list_concat(used[:claim], [true], used[claim + 2:])
  FROM (SELECT turn, used, list_filter(l[turn % {SHARDS} + 1], lambda x: NOT used[x + 1])[1] AS claim
        FROM fill, lists WHERE turn < {TABLE_SIZE})),
slots AS (SELECT f.slot, p.name AS shard FROM fill f JOIN pref p ON p.i = (f.turn - 1) % {SHARDS} WHERE f.turn > 0)
SELECT d.doc_id, s.slot::int AS slot, s.shard
FROM documents d JOIN slots s
  ON s.slot = ('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 8))::bigint % {TABLE_SIZE}
"""
