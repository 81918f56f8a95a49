"""Indexing end to end: transcripts to media, sentences, segments and topics, batch by batch.

A batch's rows are in folders of its number, and its media are written last: a batch that is run again (after a crash,
by the stream's checkpoint) finds that its documents are not there yet and writes the same folders anew. Topics go on
from what earlier batches have left: a batch adds the states of the topics it has changed, and a topic's state is the
one with most members. A document whose key is there already is not indexed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.operators import indexing, models
from plenum.sources import documents
from plenum.streaming import ingest

Load = Callable[[], Callable[[list[str]], Sequence]]


@dataclass(frozen=True)
class Tables:
    """The folder of the index; each table is a folder in it, with a folder for each batch."""

    root: str

    def write(self, name: str, rows: DataFrame, number: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The table with its column ``batch``; None before the first batch."""
        try:
            return spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def finished(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of the batches that were written to the end."""
        return self.read(spark, name).join(self.read(spark, "media").select("batch").distinct(), "batch", "left_semi")


@dataclass(frozen=True)
class Settings:
    """The model, by name and function, and the thresholds of segments and topics."""

    model: str
    load: Load
    similarity: float = C.SEGMENT_SIMILARITY
    seconds: float = C.SEGMENT_SECONDS
    topic: float = C.TOPIC_SIMILARITY


def index_batch(docs: DataFrame, tables: Tables, number: int, settings: Settings) -> None:
    """Index ``docs`` (s3_transcript_key, timestamp, filename, segments) as batch ``number``."""
    spark = docs.sparkSession
    docs = docs.dropDuplicates(["s3_transcript_key"])
    known = tables.read(spark, "media")
    if known is not None:
        docs = docs.join(known.where(F.col("batch") != number).select("s3_transcript_key"), "s3_transcript_key", "left_anti")
    media = ingest.media_rows(docs)

    # Sentences with vectors; those for which the model fails are gone, and the others are numbered without gaps.
    vectors = models.embedded(ingest.indexed(docs), settings.model, settings.load)
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("sentence_index")) - 1
    vectors = tables.write("work/sentences", vectors.withColumn("sentence_index", order), number)
    placed = indexing.segments(vectors, similarity=settings.similarity, seconds=settings.seconds)
    placed = placed.withColumn("segment_id", documents.deterministic_id(F.col("media_id"), F.col("segment_index").cast("string")))
    sentences = tables.write("sentences", vectors.join(placed, ["media_id", "sentence_index"]), number)

    segments = indexing.segment_rows(sentences.withColumnRenamed("segment_id", "_id"))
    segments = segments.withColumn("segment_id", documents.deterministic_id(F.col("media_id"), F.col("segment_index").cast("string")))
    segments = models.embedded(segments, settings.model, settings.load)
    segments = tables.write("work/segments", segments.join(media.select("media_id", "station", "media_type", "segment_time"), "media_id"), number)

    before = tables.read(spark, "topics")
    before = before.where(F.col("batch") < number).drop("batch") if before is not None else None
    old = indexing.topic_table(before, "station") if before is not None else None
    assigned = indexing.topics(segments, "station", ["segment_time", "media_id", "segment_index"], threshold=settings.topic, id_column="segment_id", known=old, states=True)
    assigned = tables.write("work/topics", assigned, number)
    tables.write("topics", indexing.topic_table(assigned, "station"), number)
    tables.write("segments", segments.join(assigned.select("segment_id", F.concat_ws("/", "station", "topic").alias("topic_id")), "segment_id", "left"), number)
    tables.write("media", media, number)


def run(stream: DataFrame, tables: Tables, checkpoint: str, settings: Settings) -> StreamingQuery:
    """Index what a stream of documents (``ingest.transcript_stream``) holds, and end."""
    return stream.writeStream.foreachBatch(lambda docs, number: index_batch(docs, tables, number, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def topics(spark: SparkSession, tables: Tables) -> DataFrame:
    """(station, topic, members, centroid) as the finished batches have left them."""
    return indexing.topic_table(tables.finished(spark, "topics").drop("batch"), "station")
