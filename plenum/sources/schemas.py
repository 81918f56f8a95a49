"""Schemas of the tables and of the JSON documents."""

from __future__ import annotations

MEDIA = "media_id string, station string, media_type string, segment_time timestamp, s3_audio_key string, s3_transcript_key string, duration_seconds double, status string, created_at timestamp"
TOPICS = "topic_id string, centroid array<float>, segment_count int, label string, created_at timestamp, updated_at timestamp"
SEGMENTS = "segment_id string, media_id string, topic_id string, segment_index int, start_time double, end_time double, text string, embedding_he array<float>, speakers array<string>, sentence_count int, is_noise boolean, noise_type string, created_at timestamp"
SENTENCES = "sentence_id string, media_id string, segment_id string, sentence_index int, start_time double, end_time double, text string, embedding_he array<float>, speaker string, is_noise boolean, noise_type string, created_at timestamp"

TRANSCRIPT = "timestamp string, filename string, segments array<struct<start: double, end: double, text: string, speaker: string, speaker_confidence: double>>"
SPAN = "array<struct<start: double, end: double, label: string, duration: double>>"
_SUMMARY = ", ".join(f"{x}_segments: int, {x}_seconds: double, {x}_pct: double" for x in ("speech", "music", "silence", "noise"))
NOISE_MAP = f"noise_spans {SPAN}, speech_spans {SPAN}, all_segments {SPAN}, summary struct<audio_duration: double, total_segments: int, classifier: string, {_SUMMARY}>, detected_at string"
EVENT = "Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>, bucket string, key string"
