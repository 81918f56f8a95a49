"""Queries by stored indexes (vectors, token postings, trigram postings) and by the distance rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import query as Q
from plenum.operators import search, stats, text_index, vector_index
from plenum.plans import searches, spans
from plenum.plans.base import query_vector, searchable, table, vectors
from plenum.plans.searches import DOCS, has
from plenum.sources import colocated, store

# Built once for an application and state of the tables.


def vector_cells(spark: SparkSession, d: str) -> vector_index.VectorIndex:
    path = store.once(spark, "vectors", [f"{d}/embeddings.parquet"], lambda to: vector_index.write(vectors(spark, d), to))
    return vector_index.read(spark, path)


def token_postings(spark: SparkSession, d: str) -> text_index.Postings:
    path = store.once(spark, "tokens", [f"{d}/documents.parquet"], lambda to: text_index.write_tokens(searchable(spark, d), to, "segment_id"))
    return text_index.read(spark, path)


def trigram_postings(spark: SparkSession, d: str) -> text_index.Postings:
    path = store.once(spark, "trigrams", [f"{d}/documents.parquet"], lambda to: text_index.write_trigrams(searchable(spark, d), to, "segment_id"))
    return text_index.read(spark, path)


def _similar(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("similarity", 6).alias("similarity"))


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: two thirds of the cells, by codes, then by vectors."""
    return _similar(vector_index.find(vector_cells(spark, d), query_vector(spark, d)))


def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    return _similar(vector_index.find(vector_cells(spark, d), query_vector(spark, d), exact=True))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding_he").alias("vector"))


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20, against all rows, by all cells."""
    index = vector_cells(spark, d)
    return vector_index.find_all(index, _asked(spark, d), 20, max(len(index.cells), 1)).select("query_id", "id", "place", F.round("similarity", 6).alias("similarity"))


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """For each of these queries, how many of its 20 nearest rows the probed cells alone give."""
    index = vector_cells(spark, d)
    near = vector_index.find_all(index, _asked(spark, d), 20).select("query_id", "id", F.lit(1).alias("met"))
    whole = vector_index.find_all(index, _asked(spark, d), 20, max(len(index.cells), 1)).select("query_id", "id")
    return whole.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("met").alias("found"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("segment_id"), F.round("rank", 6).alias("rank"))


def keyword_index_plain(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword(token_postings(spark, d), "the of", 20, by_distance=False))


def keyword_index_or(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword_query(token_postings(spark, d), Q.parse("einer OR para"), None, 30, by_distance=False))


def keyword_index_not(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword_query(token_postings(spark, d), Q.parse("the NOT of -was"), None, 30, by_distance=False))


def keyword_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword_query(token_postings(spark, d), Q.parse('"of the" in'), None, 30, by_distance=False, station="src1"))


def keyword_distance_plain(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword(token_postings(spark, d), "the of", 20))


def keyword_distance_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(text_index.keyword_query(token_postings(spark, d), Q.parse('"of the" in'), None, 30, station="src1"))


def keyword_distance_scan(spark: SparkSession, d: str) -> DataFrame:
    """By the stored token columns of all segments, as a search without an index has it; an exclusion joins tokens."""
    found = search.keyword_query(searchable(spark, d), Q.parse("the in NOT was"), None, 30, "segment_id", by_distance=True)
    return found.select("segment_id", F.round("rank", 6).alias("rank"))


def trigram_index_topk(spark: SparkSession, d: str) -> DataFrame:
    found = text_index.trigram(trigram_postings(spark, d), "the of and in to with", 20, 0.05)
    return found.select(F.col("id").alias("segment_id"), F.round("similarity", 6).alias("similarity"))


def enrich_colocated(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation with its turns nested, from tables that are bucketed by conversation."""

    def write(to: str) -> None:
        turns = table(spark, d, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("sentence_index"), "text")
        colocated.write(turns, f"{to}-sentences", "segment_id", ("sentence_index",), 8)
        colocated.write(turns.where("sentence_index = 0").select("segment_id").distinct(), f"{to}-segments", "segment_id", (), 8)

    path = store.once(spark, "together", [f"{d}/conversations.parquet"], write)
    results, sentences = (colocated.read(spark, f"{path}-{x}") for x in ("segments", "sentences"))
    nested = search.enrich(results, sentences.where(F.col("sentence_index") > 0))
    joined = F.array_join(F.transform("sentences", lambda s: F.concat(s["sentence_index"].cast("string"), F.lit(":"), F.md5(s["text"]))), ",")
    return nested.select("segment_id", F.size("sentences").alias("n"), joined.alias("sentences"))


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def write(to: str) -> None:
        orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_orderpriority").alias("station"), F.col("o_orderstatus").alias("media_type"), F.col("o_orderdate").alias("segment_time"))
        lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_suppkey").alias("topic_id"), F.col("l_quantity").alias("quantity"))
        colocated.write(orders, f"{to}-media", "media_id", (), 8)
        colocated.write(lines, f"{to}-segments", "media_id", (), 8)

    path = store.once(spark, "hierarchy", [f"{d}/orders.parquet", f"{d}/lineitem.parquet"], write)
    return colocated.read(spark, f"{path}-media"), colocated.read(spark, f"{path}-segments")


def media_stats_colocated(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of recordings, segments and sentences, joined by recording where they lie."""
    media, segs = _orders(spark, d)
    return stats.index_stats(media, segs.drop("quantity"), segs.where("quantity > 25").select("media_id"))


def _distance_sql(words: tuple[str, ...], match: str, n: int) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH hit AS (SELECT segment_id, t FROM {DOCS} WHERE {match}),
tok AS (SELECT segment_id, w, p FROM (SELECT segment_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM hit) WHERE w IN ({listed})),
pairs AS (SELECT a.segment_id, sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5::double - 2))))) AS s
  FROM tok a JOIN tok b ON a.segment_id = b.segment_id AND a.w < b.w AND abs(a.p - b.p) BETWEEN 1 AND 100 GROUP BY a.segment_id)
SELECT segment_id, round(greatest(1 - exp(coalesce(s, 0)), 1e-20)::float::double, 6) AS rank FROM hit LEFT JOIN pairs USING (segment_id)
ORDER BY greatest(1 - exp(coalesce(s, 0)), 1e-20)::float DESC, segment_id LIMIT {n}"""


SQL = {
    "enrich_colocated": searches.SQL["enrich"],
    "media_stats_colocated": spans.SQL["index_stats"],
    "vector_index_exact": searches.SQL["semantic_topk"],
    "vector_neighbours": """WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings)
SELECT q.vec_id AS query_id, e.vec_id AS id, (row_number() OVER by_query)::int AS place, round(list_cosine_similarity(q.v, e.v), 6) AS similarity
FROM e q, e WHERE q.vec_id % 20 = 0 WINDOW by_query AS (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) QUALIFY place <= 20""",
    "keyword_index_plain": searches.SQL["keyword_plain"],
    "keyword_index_or": searches.SQL["keyword_or"],
    "keyword_index_not": searches.SQL["keyword_not"],
    "keyword_index_phrase": searches.SQL["keyword_phrase"],
    "keyword_distance_plain": _distance_sql(("the", "of"), f"{has('the')} AND {has('of')}", 20),
    "keyword_distance_phrase": _distance_sql(("of", "the", "in"), f"{has('in')} AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND station = 'src1'", 30),
    "keyword_distance_scan": _distance_sql(("the", "in"), f"{has('the')} AND {has('in')} AND NOT {has('was')}", 30),
    "trigram_index_topk": searches.SQL["trigram_topk"],
}

QUERIES = {f.__name__: f for f in (vector_index_topk, vector_index_exact, vector_neighbours, vector_index_recall, keyword_index_plain, keyword_index_or, keyword_index_not, keyword_index_phrase, keyword_distance_plain, keyword_distance_phrase, keyword_distance_scan, trigram_index_topk, enrich_colocated, media_stats_colocated)}
