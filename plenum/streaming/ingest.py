"""Transcripts as a stream of files: discovered, indexed once each, appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from plenum.functions import times
from plenum.operators import indexing, noise
from plenum.sources import documents, schemas


def transcript_stream(spark: SparkSession, path: str, per_trigger: int = 1000, max_age: str = "2h") -> DataFrame:
    """New documents below ``path``; each file is seen once, also over restarts (by the checkpoint)."""
    return (
        spark.readStream.schema(schemas.TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_diarized.json").option("maxFilesPerTrigger", per_trigger).option("maxFileAge", max_age)
        .json(path).withColumn("s3_transcript_key", F.col("_metadata.file_path"))
    )


def indexed(docs: DataFrame) -> DataFrame:
    """Sentences of documents (s3_transcript_key, segments): turns, sentence times, advertisements removed, numbered
    without gaps."""
    keyed = docs.withColumn("media_id", documents.deterministic_id(F.col("s3_transcript_key")))
    turns = indexing.turns(documents.positions(keyed, ["media_id", "s3_transcript_key"]).drop("s3_transcript_key"))
    cut = indexing.sentences(turns, ["media_id", "turn"])
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("turn", "part")) - 1
    placed = cut.withColumn("sentence_index", order)
    kept = noise.index_ads(placed).where("not is_ad").drop("is_ad")
    again = F.row_number().over(Window.partitionBy("media_id").orderBy("sentence_index")) - 1
    return kept.withColumn("sentence_index", again).select("media_id", "sentence_index", "start", "end", "text", "speaker")


def media_rows(docs: DataFrame) -> DataFrame:
    key = F.regexp_extract("s3_transcript_key", r"((?:tv/)?[^/]+/[^/]+)$", 1)
    return docs.select(documents.deterministic_id(F.col("s3_transcript_key")).alias("media_id"), times.station(key).alias("station"), times.media_type(times.station(key)).alias("media_type"), times.recording_time(key, F.col("timestamp"), F.col("filename")).alias("segment_time"), times.audio_key(key).alias("s3_audio_key"), "s3_transcript_key")


def run(stream: DataFrame, media_path: str, sentences_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = indexed) -> StreamingQuery:
    """Index what is there and end. A batch that is run again finds its documents in the media table, which is written
    last, and rewrites nothing else than its own folder."""

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        docs = docs.dropDuplicates(["s3_transcript_key"])
        own, known = media_rows(docs), None
        try:
            known = spark.read.parquet(media_path)
        except Exception as e:  # noqa: BLE001  the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        if known is not None:
            docs = docs.join(known.where(F.col("batch") != number).select("s3_transcript_key"), "s3_transcript_key", "left_anti")
            own = own.join(docs.select("s3_transcript_key"), "s3_transcript_key", "left_semi")
        process(docs).write.mode("overwrite").parquet(f"{sentences_path}/batch={number}")
        own.write.mode("overwrite").parquet(f"{media_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
