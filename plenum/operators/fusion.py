"""Reciprocal rank fusion of ranked signals, with similarity factors, penalties and a floor.

A signal is a DataFrame that holds segment_id, rank_in_signal and either ``similarity`` or ``rank``; signals are
small (at most twice the limit each), and what crosses the shuffle is their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.functions import text as T


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` of one signal with their place (1-based). A signal is a top-k, so one task sorts k rows."""
    return rows.withColumn("rank_in_signal", F.row_number().over(Window.orderBy(*order)))


def gated(rows: DataFrame, gate: float = C.COSINE_GATE) -> DataFrame:
    """All of a semantic signal, or nothing if its best similarity is below the gate."""
    return rows.withColumn("_best", F.max("similarity").over(Window.partitionBy(F.lit(0)))).where(F.col("_best") >= gate).drop("_best")


def merge(signals: dict[str, DataFrame], limit: int = 20, weights: dict[str, float] | None = None, k: int = C.RRF_K) -> DataFrame:
    """segment_id, text, score, signal_count, signal_list, match_type of the fused list, best first.

    Only a segment's first row in a signal counts, but it keeps its place in the raw list. Columns come from the first
    signal that found the segment. A null segment is dropped."""
    weights = C.SIGNAL_WEIGHTS if not weights else weights
    parts = []
    for at, (name, rows) in enumerate(signals.items()):
        value = {c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in ("similarity", "rank")}
        parts.append(rows.select("segment_id", F.col("text"), "rank_in_signal", value["similarity"].alias("similarity"), value["rank"].alias("rank"), F.lit(name).alias("signal"), F.lit(at).alias("at"), F.lit(float(weights.get(name, C.OTHER_WEIGHT))).alias("w")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = F.row_number().over(Window.partitionBy("signal", "segment_id").orderBy("rank_in_signal"))
    rows = rows.where(F.col("segment_id").isNotNull()).withColumn("_n", first).where("_n = 1")
    rows = rows.withColumn("part", F.col("w") * T.similarity_factor(F.col("similarity"), F.col("rank")) / (F.lit(k) + F.col("rank_in_signal")))
    fused = rows.groupBy("segment_id").agg(
        F.sum("part").alias("raw"),
        F.min_by(F.struct("text", "signal", "at", "rank_in_signal"), "at").alias("head"),
        F.array_sort(F.collect_set("signal")).alias("names"),
    )
    fused = fused.select(
        "segment_id",
        F.col("head.text").alias("text"),
        (F.col("raw") * T.quality_penalty(F.col("head.text"))).alias("score"),
        F.size("names").alias("signal_count"),
        F.array_join("names", "+").alias("signal_list"),
        F.when(F.size("names") > 1, "hybrid").otherwise(F.col("head.signal")).alias("match_type"),
        F.col("head.at").alias("_at"),
        F.col("head.rank_in_signal").alias("_place"),
    )
    best = F.max("score").over(Window.partitionBy(F.lit(0)))
    kept = fused.withColumn("_best", best).where((F.col("_best") >= C.LEAST_SCORE) & (F.col("score") >= F.greatest(F.lit(C.LEAST_SCORE), F.col("_best") * C.FLOOR_SHARE)))
    return kept.orderBy(F.col("score").desc(), "_at", "_place", "segment_id").limit(limit).drop("_best", "_at", "_place")


def without(rows: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows whose text holds none of the excluded terms, in any case."""
    for x in excluded:
        rows = rows.where(~F.lower(F.coalesce("text", F.lit(""))).contains(x.lower()))
    return rows


def reranked(rows: DataFrame, score, head: int = 20, cut: int = 512) -> DataFrame:
    """The first ``head`` rows by the model's score, the others behind in their order. ``score`` maps a text column to
    a number (``models.scorer``), null to null; it sees ``cut`` characters, as the model's input is bounded."""
    order = Window.orderBy(F.col("score").desc(), "segment_id")
    placed = rows.withColumn("_prior", F.row_number().over(order))
    top = F.col("_prior") <= head
    placed = placed.withColumn("rerank_score", score(F.when(top, F.substring("text", 1, cut))))
    return placed.orderBy(top.desc(), F.col("rerank_score").desc(), "_prior").drop("_prior")
