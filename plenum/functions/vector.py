"""Vectors as array columns: dot product, norm, cosine, means. All of it stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(_double(a), 1, n), F.slice(_double(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0.0 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine to one query vector whose norm is taken once, on the driver; one pass over the column's array."""
    size = math.sqrt(sum(x * x for x in query))
    if size == 0:
        return F.lit(0.0)
    unit = literal([x / size for x in query])
    pair = F.aggregate(
        F.zip_with(_double(a), unit, lambda x, y: F.struct((x * y).alias("d"), (x * x).alias("n"))),
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")),
        lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")),
        lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["d"] / F.sqrt(s["n"])),
    )
    return pair


def sanitize(a: Column) -> Column:
    """NaN and infinities become 0; an all-zero vector becomes null."""
    clean = F.transform(_double(a), lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(0.0)).otherwise(x))
    return F.when(F.forall(clean, lambda x: x == 0), F.lit(None)).otherwise(clean)


def running_mean(old: Column, count: Column, new: Column) -> Column:
    """(old * count + new) / (count + 1), by element."""
    return F.zip_with(_double(old), _double(new), lambda x, y: (x * count + y) / (count + 1))


def mean_by(rows: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key, centroid, members): the (weighted) mean vector of each key. Elements are pre-aggregated on the map side,
    so a hot key costs a row for each task and element."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.select(key, w.alias("_w"), F.posexplode(_double(F.col(vector))).alias("_i", "_x"))
    sums = parts.groupBy(key, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"), F.count("*").alias("_n"))
    whole = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_e"), F.max("_n").alias("members"))
    return whole.select(key, F.transform("_e", lambda e: e["_m"]).alias("centroid"), "members")
