"""Queries by a model that runs inside tasks: vectors of documents, segments of them, a reranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import fusion, models, search
from plenum.plans.base import searchable, table
from plenum.sources import store
from plenum.streaming import indexer

BUCKETS, DIMS = 4096, 16


def _model(spark: SparkSession, d: str) -> models.HashedVectors:
    return models.train_vectors(table(spark, d, "documents"), "text", BUCKETS, DIMS)


def _named(model: models.HashedVectors) -> str:
    """A worker may live longer than a model: a model's name tells its weights."""
    return f"hashed-{hash(model.weights.tobytes())}"


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    model = _model(spark, d)
    found = models.embedded(table(spark, d, "documents").select("doc_id", "text"), _named(model), lambda: model)
    return found.select("doc_id", F.posexplode("embedding_he").alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 4).alias("x"))


RERANK_QUERY = "the license of this work"


def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    """The 40 best rows by keywords, the first 20 of them in the order of the model's likeness to the query."""
    model = _model(spark, d)
    wanted = model([RERANK_QUERY])[0]
    likeness = models.scorer(_named(model) + RERANK_QUERY, lambda: lambda texts: [float(v @ wanted) for v in model(texts)])
    found = search.keyword(searchable(spark, d), "the of", 40, "segment_id")
    ranked = fusion.reranked(found.withColumn("score", F.col("rank")), likeness)
    return ranked.select("segment_id", F.round("rank", 6).alias("rank"), F.round("rerank_score", 6).alias("rerank_score"))


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts of recordings, indexed in two batches: segments with their topics."""
    model, tables = _model(spark, d), indexer.Tables(store.fresh(spark, "index"))
    turn = F.struct((F.col("turn") * 60.0).alias("start"), (F.col("turn") * 60.0 + 60).alias("end"), "text", F.col("role").alias("speaker"), F.lit(0.9).alias("speaker_confidence"))
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("segments"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 60), "yyyy-MM-dd_HH-mm")
    key = F.concat(F.lit("st"), F.col("conv_id") % 3, F.lit("/"), stamp, F.lit("_"), "conv_id", F.lit("_diarized.json"))
    docs = docs.select(key.alias("s3_transcript_key"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("filename"), "segments", "conv_id")
    half = F.col("conv_id") < docs.agg(F.max("conv_id") / 2).first()[0]
    settings = indexer.Settings(_named(model), lambda: model, 0.3, 300, 0.6)
    indexer.index_batch(docs.where(half), tables, 0, settings)
    indexer.index_batch(docs.where(~half), tables, 1, settings)
    return tables.finished(spark, "segments").select("batch", "media_id", "segment_id", "station", "segment_index", "sentence_count", "start_time", "end_time", "topic_id")


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
SQL = {
    "document_vectors": f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::bigint AS h FROM w),
idf AS (SELECT h % {BUCKETS} AS b, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))::double) AS x FROM h GROUP BY b),
v AS (SELECT doc_id, (b % {DIMS})::int AS i, sum(CASE WHEN h // {BUCKETS} % 2 = 1 THEN x ELSE -x END) AS x FROM h JOIN idf ON b = h % {BUCKETS} GROUP BY doc_id, i),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM v GROUP BY doc_id)
SELECT d.doc_id, g.i::int AS i, round(coalesce(v.x / nullif(n, 0), 0)::float::double, 4) AS x FROM documents d CROSS JOIN range({DIMS}) g(i) LEFT JOIN v ON v.doc_id = d.doc_id AND v.i = g.i LEFT JOIN n ON n.doc_id = d.doc_id""",
}

QUERIES = {f.__name__: f for f in (document_vectors, rerank_head, index_documents)}
