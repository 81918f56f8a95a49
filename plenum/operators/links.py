"""What indexing writes back into tables by key: links between sentences, segments and topics, and noise flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators import intervals, noise
from plenum.sources.keyed import KeyedTable


def link_segments(sentences: KeyedTable, placed: DataFrame) -> int:
    """Write each sentence's segment into the sentences' table; ``placed``: (key, sentence_index, segment_id)."""
    return sentences.update(placed.select(sentences.key, "sentence_index", "segment_id"), [sentences.key, "sentence_index"])


def link_topics(segments: KeyedTable, assigned: DataFrame) -> int:
    """Write each segment's topic into the segments' table; ``assigned``: (key, segment_id, topic_id)."""
    return segments.update(assigned.select(segments.key, "segment_id", "topic_id"), [segments.key, "segment_id"])


def write_noise(sentences: KeyedTable, segments: KeyedTable, found: DataFrame) -> tuple[int, int]:
    """Set the flags of all recordings with a detection anew: detected sentences are noise, the recording's others are
    not, and a segment is noise if all of its sentences are, by their most frequent type. ``found``: (key,
    sentence_index, noise_type). Recordings without a detection keep their flags and their files."""
    key = sentences.key
    own = sentences.of(found)
    flagged = noise.flagged(own, found, key)
    # Both tables are told from what the first one held, so that a second try after the first write does no harm.
    whole = noise.propagated(flagged).join(own.where("segment_id IS NOT NULL").select(key, "segment_id").distinct(), "segment_id")
    first = sentences.update(flagged.select(key, "sentence_index", "is_noise", "noise_type"), [key, "sentence_index"])
    again = segments.update(whole.select(key, "segment_id", "is_noise", "noise_type"), [key, "segment_id"])
    return first, again


def filter_noise(sentences: KeyedTable, segments: KeyedTable, spans: DataFrame | None = None, media: DataFrame | None = None, wanted: noise.Phrases = noise.Phrases()) -> tuple[int, int]:
    """The later noise filter as a whole, over all recordings or those of ``media``: detect by text and by audio spans
    (key, s, e, label, span_index), set the flags of recordings with a detection anew, and hand them on to segments."""
    rows = sentences.read() if media is None else sentences.of(media)
    audio = None
    if spans is not None:
        timed = rows.select(sentences.key, "sentence_index", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
        audio = intervals.noisy_sentences(timed, spans, sentences.key)
    return write_noise(sentences, segments, noise.detections(rows, audio, sentences.key, "sentence_index", wanted))


def clear_noise(sentences: KeyedTable, segments: KeyedTable, media: DataFrame) -> tuple[int, int]:
    """The flags of the given recordings back to none, in both tables."""
    out = []
    for table in (sentences, segments):
        out.append(table.replace(noise.reset(table.of(media), media, table.key), media))
    return out[0], out[1]
