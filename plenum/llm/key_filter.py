"""A bit filter of keys for a first, broadcast look before a shuffle. It never loses a key; others may pass.

The filter is a table (w, v) of 64-bit words that have a bit, at most ``MAX_WORDS`` rows whatever the number of keys,
so broadcasting it has a proven bound. With very many keys it lets more pass; results don't depend on it, since an exact
join follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.scratch import materialise, unused

MAX_WORDS = 1 << 19


@dataclass
class KeyFilter:
    table: DataFrame
    words: int

    def flagged(self, rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
        """``rows`` with a boolean: may the keys (columns) be among those of the filter? False if one is null. A
        column named like the flag is replaced; all others are kept, whatever their names."""
        h, known = F.xxhash64(*keys), F.lit(True)
        for k in keys:
            known &= F.col(k).isNotNull()
        w, v = unused(rows, "w"), unused(rows, "v")
        bits = F.broadcast(self.table.select(F.col("w").alias(w), F.col("v").alias(v)))
        hit = F.getbit(F.col(v), F.shiftrightunsigned(h, 58).cast("int")) == 1
        out = rows.withColumn(w, F.pmod(h, F.lit(self.words))).join(bits, w, "left")
        return out.withColumn(flag, F.coalesce(hit, F.lit(False)) & known).drop(w, v)

    def maybe(self, rows: DataFrame, *keys: str) -> DataFrame:
        flag = unused(rows, "maybe")
        return self.flagged(rows, list(keys), flag).where(F.col(flag)).drop(flag)


def key_filter(rows: DataFrame, *keys: str) -> KeyFilter:
    n, words = rows.count(), 1 << 10
    while words < MAX_WORDS and words < n:
        words *= 2
    h: Column = F.xxhash64(*keys)
    bits = rows.select(F.pmod(h, F.lit(words)).alias("w"), F.shiftrightunsigned(h, 58).cast("int").alias("s"))
    table = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("v"))
    return KeyFilter(materialise(table, "bits"), words)
