"""What the registered queries share: tables in their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.session import shared_dir
from plenum.sources import documents, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("segment_id"), "text", F.col("source").alias("station"), F.col("lang").alias("media_type"))


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments with the stored token columns that keyword and trigram searches read. They are written
    once for an application and state of the table, into the shared folder; without one they are computed."""
    rows = documents.with_tokens(documents_as_segments(spark, sf_dir))
    if shared_dir(spark) is None:
        return rows
    path = store.once(spark, "searchable", [f"{sf_dir}/documents.parquet"], lambda to: rows.write.parquet(to))
    return spark.read.schema(rows.schema).parquet(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_he"), F.col("label").alias("topic_id"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as the query: one row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


#: SQL of the query vector, and of tokens and words as plenum.functions.text has them.
Q_SQL = "(SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)"
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
