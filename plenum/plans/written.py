"""Queries of documents as they are written (noise maps, diarized transcripts, segments) and of the older searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import indexing, intervals, search
from plenum.plans.base import Q_SQL, query_vector, table, vectors
from plenum.plans.searches import SIM
from plenum.plans.spans import _E, _events, _sides
from plenum.plans.spans import SQL as SPANS_SQL
from plenum.sources import documents, store

def _label() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "view", "speech").when(kind == "click", "music").when(kind == "error", "silence").otherwise("noise")


def noise_maps(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as spans of a recording: the maps are written as documents and read back."""
    spans = _events(spark, d).select(F.col("user_id").cast("string").alias("media_id"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), _label().alias("label"))
    path = store.fresh(spark, "maps")
    documents.write_json(documents.noise_map(spans), path)
    found = documents.noise_maps(spark, path)
    noisy = documents.spans_of(found).groupBy("media_id").agg(F.count("*").alias("noise_spans"), F.round(F.sum(F.col("e") - F.col("s")), 2).alias("noise_total"))
    out = found.drop("noise_spans").join(noisy, "media_id", "left").withColumn("s", F.col("summary"))
    return out.select("media_id", "noise_spans", "noise_total", F.size("speech_spans").alias("speech_spans"), "s.audio_duration", "s.total_segments", "s.classifier", *(f"s.{x}_{y}" for x in documents.LABELS for y in ("segments", "seconds", "pct")))


def diarized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Users as recordings with segments and turns, their start from the audio's key."""
    segs, turns = _sides(spark, d)
    assigned = intervals.assign_speakers(segs.withColumn("text", F.lit("")), turns.drop("label", "span_index"))
    docs = turns.select("media_id").distinct().select("media_id", F.concat(F.lit("st/"), "media_id", F.lit("_transcript.json")).alias("s3_transcript_key"), F.concat(F.lit("st/2026-03-"), F.lpad(F.col("media_id") % 28 + 1, 2, "0"), F.lit("_08-30.mp3")).alias("s3_audio_key"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("filename"))
    found = documents.diarized(docs, assigned, turns.select("media_id", "s", "e", "speaker"), model="m1", device="cpu")
    parts = found.select("media_id", "timestamp", "timezone", "diarization.model", "diarization.speaker_count", "diarization.turn_count", F.size("segments").alias("segments"), F.explode("segments").alias("x"))
    named = parts.groupBy("media_id", "timestamp", "timezone", "model", "speaker_count", "turn_count", "segments")
    return named.agg(F.count_if(F.col("x.speaker") == "view").alias("viewed"), F.round(F.sum("x.speaker_confidence"), 3).alias("confidence"))


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments of three turns: their times, text, and speakers in order of first speech."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("sentence_index"), F.floor(F.col("turn") / 3).cast("int").alias("segment_index"), (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"), "text", F.col("role").alias("speaker"))
    return indexing.segment_rows(turns).select("media_id", "segment_index", "start_time", "end_time", "sentence_count", F.md5("text").alias("digest"), F.array_join("speakers", "+").alias("speakers"))


def semantic_quality(spark: SparkSession, d: str) -> DataFrame:
    """The older search by quality: labels are the scores, and rows without one pass."""
    scores = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality_score"))
    rows = vectors(spark, d).join(scores, F.col("id") == F.col("doc_id"), "left")
    return search.semantic(search.good_enough(rows), query_vector(spark, d), 30, 0.1).select("id", F.round("similarity", 6).alias("similarity"))


def semantic_second_space(spark: SparkSession, d: str) -> DataFrame:
    """The search of another vector space: each vector backwards."""
    rows = vectors(spark, d).withColumn("embedding_ml", F.reverse("embedding_he"))
    return search.semantic(rows, query_vector(spark, d)[::-1], 20, 0.18, embedding="embedding_ml").select("id", F.round("similarity", 6).alias("similarity"))


def semantic_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are flagged as noise don't match; those that were never looked at do."""
    flags = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("is_noise"))
    rows = vectors(spark, d).join(flags, F.col("id") == F.col("doc_id"), "left")
    return search.semantic(rows, query_vector(spark, d), 30, 0.1).select("id", F.round("similarity", 6).alias("similarity"))


def _by_label(test: str, n: int = 30) -> str:
    return f"SELECT vec_id AS id, round(s, 6) AS similarity FROM (SELECT vec_id, quality, {SIM} AS s FROM embeddings LEFT JOIN labels ON doc_id = vec_id) WHERE s > 0.1 AND {test} ORDER BY s DESC, vec_id LIMIT {n}"


_SUMS = ", ".join(f"count(*) FILTER (WHERE label = '{x}')::int AS {x}_segments, round(coalesce(sum(d) FILTER (WHERE label = '{x}'), 0), 2) AS {x}_seconds, round(100 * coalesce(sum(d) FILTER (WHERE label = '{x}'), 0) / max(round(e, 2)), 1) AS {x}_pct" for x in documents.LABELS)
SQL = {
    "noise_maps": f"""WITH s AS (SELECT user_id::varchar AS media_id, round(s, 2) AS s, round(e, 2) AS e, round(round(e, 2) - round(s, 2), 3) AS d, CASE event_type WHEN 'view' THEN 'speech' WHEN 'click' THEN 'music' WHEN 'error' THEN 'silence' ELSE 'noise' END AS label FROM {_E} WHERE e IS NOT NULL)
SELECT media_id, nullif(count(*) FILTER (WHERE label <> 'speech'), 0) AS noise_spans, round(sum(e - s) FILTER (WHERE label <> 'speech'), 2) AS noise_total, count(*) FILTER (WHERE label = 'speech')::int AS speech_spans,
  max(round(e, 2)) AS audio_duration, count(*)::int AS total_segments, 'spectral' AS classifier, {_SUMS} FROM s GROUP BY media_id""",
    "diarized_documents": f"""WITH a AS ({SPANS_SQL['speaker_assign']}), t AS (SELECT user_id AS m, count(*) AS turns, count(DISTINCT event_type) AS speakers FROM {_E} WHERE e IS NOT NULL GROUP BY user_id)
SELECT m AS media_id, '2026-03-' || lpad((m % 28 + 1)::varchar, 2, '0') || 'T08:30:00' || CASE WHEN m % 28 + 1 >= 27 THEN '+03:00' ELSE '+02:00' END AS timestamp, 'Asia/Jerusalem' AS timezone, 'm1' AS model,
  any_value(speakers) AS speaker_count, any_value(turns) AS turn_count, count(*)::int AS segments, count(*) FILTER (WHERE speaker = 'view') AS viewed, round(sum(confidence), 3) AS confidence FROM a JOIN t ON t.m = a.media_id GROUP BY m""",
    "segment_rows": """SELECT conv_id AS media_id, (turn // 3)::int AS segment_index, min(turn) * 2.5::double AS start_time, max(turn) * 2.5::double + 2 AS end_time, count(*)::int AS sentence_count,
  md5(string_agg(text, ' ' ORDER BY turn)) AS digest, array_to_string(list_distinct_in_order, '+') AS speakers
FROM (SELECT *, (SELECT list(role ORDER BY f) FROM (SELECT role, min(turn) AS f FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn // 3 = c.turn // 3 GROUP BY role)) AS list_distinct_in_order FROM conversations c) GROUP BY conv_id, turn // 3, list_distinct_in_order""",
    "semantic_quality": _by_label("(quality IS NULL OR quality > 0.15)"),
    "semantic_second_space": f"SELECT vec_id AS id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(list_reverse(embedding::double[]), list_reverse((SELECT v FROM {Q_SQL}))) AS s FROM embeddings) WHERE s > 0.18 ORDER BY s DESC, vec_id LIMIT 20",
    "semantic_without_noise": _by_label("(quality IS NULL OR quality <> 0)"),
}

QUERIES = {f.__name__: f for f in (noise_maps, diarized_documents, segment_rows, semantic_quality, semantic_second_space, semantic_without_noise)}
