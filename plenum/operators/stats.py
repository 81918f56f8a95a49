"""Statistics of the index and of noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(media: DataFrame, segments: DataFrame, sentences: DataFrame) -> DataFrame:
    """Counts and time range by station and media type. Each side is counted for a recording before it is joined, so
    that segments and sentences of one recording never multiply; topics stay distinct for the whole group."""
    seg = segments.groupBy("media_id").agg(F.count("*").alias("segs"))
    sen = sentences.groupBy("media_id").agg(F.count("*").alias("sents"))
    topics = segments.where(F.col("topic_id").isNotNull()).select("media_id", "topic_id").distinct()
    by = ["station", "media_type"]
    named = media.select("media_id", *by)
    topic_counts = named.join(topics, "media_id").groupBy(*by).agg(F.countDistinct("topic_id").alias("topics"))
    whole = media.join(seg, "media_id", "left").join(sen, "media_id", "left").groupBy(*by).agg(
        F.count("*").alias("media_count"),
        F.coalesce(F.sum("segs"), F.lit(0)).alias("segment_count"),
        F.coalesce(F.sum("sents"), F.lit(0)).alias("sentence_count"),
        F.min("segment_time").alias("earliest"),
        F.max("segment_time").alias("latest"),
    )
    out = whole.join(topic_counts, by, "left")
    return out.withColumn("topic_count", F.coalesce("topics", F.lit(0))).drop("topics")


def days(rows: DataFrame, time: str = "segment_time") -> DataFrame:
    """(day, n): the days that occur, and their rows."""
    return rows.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


def noise_by_type(rows: DataFrame) -> DataFrame:
    return rows.where("is_noise").groupBy("noise_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "noise_type")


def noise_by_station(rows: DataFrame, media: str = "media_id") -> DataFrame:
    """Total, noise, share in percent and recordings with noise by station."""
    noisy = F.coalesce("is_noise", F.lit(False))
    return rows.groupBy("station").agg(
        F.count("*").alias("total"),
        F.count_if(noisy).alias("noise"),
        F.round(100.0 * F.count_if(noisy) / F.count("*"), 4).alias("noise_pct"),
        F.countDistinct(F.when(noisy, F.col(media))).alias("noisy_media"),
    )


def label_durations(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans, seconds and percent of each label."""
    sums = spans.groupBy(*key, "label").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    total = spans.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("_t"))
    joined = sums.join(total, key) if key else sums.crossJoin(total)  # without a key the total is one row
    return joined.withColumn("pct", F.when(F.col("_t") > 0, F.round(100 * F.col("seconds") / F.col("_t"), 2)).otherwise(0.0)).drop("_t")
