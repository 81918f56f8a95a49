"""Queries of vector, keyword, trigram and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum import api
from plenum.functions import query as Q
from plenum.functions import text as T
from plenum.functions import vector as V
from plenum.operators import fusion, search
from plenum.plans.base import Q_SQL, TOKENS_SQL, WORDS_SQL, documents_as_segments, query_vector, searchable, table, vectors

def _sim():
    return F.round("similarity", 6).alias("similarity")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(vectors(spark, d), query_vector(spark, d)).select("id", _sim())


def semantic_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).join(documents_as_segments(spark, d), F.col("id") == F.col("segment_id"))
    return search.semantic(rows, query_vector(spark, d), 20, 0.0, station="src1", media_type="en").select("id", "station", "topic_id", _sim())


def semantic_direct(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(vectors(spark, d), query_vector(spark, d, 1), 20, 0.25).select("id", "topic_id", _sim())


def topic_segments(spark: SparkSession, d: str) -> DataFrame:
    hits = search.semantic(vectors(spark, d), query_vector(spark, d), 3)
    return search.by_topic(vectors(spark, d), hits.select("topic_id"), 20, "id", "id").select("id", "topic_id")


def search_expanded(spark: SparkSession, d: str) -> DataFrame:
    return search.expanded(vectors(spark, d), query_vector(spark, d), 5, 20, 0.18).select("id", "topic_id", _sim(), "match_type")


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_by(vectors(spark, d), "topic_id", "embedding_he")


def topic_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).select("topic_id", "members", F.posexplode("centroid").alias("i", "x")).select("topic_id", "members", "i", F.round("x", 6).alias("x"))


def nearest_topic(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest_topic(_topics(spark, d), query_vector(spark, d), 0.05).select("topic_id", _sim())


def running_centroid(spark: SparkSession, d: str) -> DataFrame:
    topics = _topics(spark, d).withColumnRenamed("members", "segment_count")
    new = search.joined_topic(topics, 1, query_vector(spark, d))
    return new.select("topic_id", "segment_count", F.posexplode("centroid").alias("i", "x")).select("topic_id", "segment_count", "i", F.round("x", 6).alias("x"))


def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("w", F.col("id") % 7 + 1)
    return V.mean_by(rows, "topic_id", "embedding_he", "w").select("topic_id", F.posexplode("centroid").alias("i", "x")).select("topic_id", "i", F.round("x", 6).alias("x"))


def _rounded():
    return F.round("rank", 6).alias("rank")


def keyword_plain(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword(searchable(spark, d), "the of", 20, "segment_id").select("segment_id", _rounded())


def keyword_or(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_query(searchable(spark, d), Q.parse("einer OR para"), None, 30, "segment_id").select("segment_id", _rounded())


def keyword_not(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_query(searchable(spark, d), Q.parse("the NOT of -was"), None, 30, "segment_id").select("segment_id", _rounded())


def keyword_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_query(searchable(spark, d), Q.parse('"of the" in'), None, 30, "segment_id", station="src1").select("segment_id", _rounded())


def trigram_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.trigram(searchable(spark, d), "the of and in to with", 20, 0.05, "segment_id").select("segment_id", _sim())


def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = documents_as_segments(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token"), "segment_id")
    return docs.groupBy("token").agg(F.count("*").alias("occurrences"), F.countDistinct("segment_id").alias("segments"))


HYBRID_QUERY, EXCLUDED = "the of", ["license"]


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Vector and keyword signals fused, with gate, penalties, floor and exclusion."""
    segs = searchable(spark, d)
    # The top of the vectors first, and then the texts of its forty rows.
    known = vectors(spark, d).withColumnRenamed("id", "segment_id").join(segs.select("segment_id"), "segment_id", "left_semi")
    he = search.semantic(known, query_vector(spark, d), 40, id_column="segment_id").select("segment_id", "similarity")
    he = segs.select("segment_id", "text").join(F.broadcast(he), "segment_id")
    kw = search.keyword(segs, HYBRID_QUERY, 40, "segment_id")
    signals = {
        "seg_he": fusion.gated(fusion.ranked(he, [F.col("similarity").desc(), F.col("segment_id")])),
        "seg_kw": fusion.ranked(kw, [F.col("rank").desc(), F.col("segment_id")]),
    }
    fused = fusion.without(fusion.merge(signals, 20), EXCLUDED)
    return fused.select("segment_id", F.round("score", 6).alias("score"), "signal_count", "signal_list", "match_type")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole request: five signals, gate, topics, fusion, exclusion and nested sentences. Conversations are segments
    of sentences beside the documents; a vector belongs to the sentence and to the segment of its number."""
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("embedding_he"), F.col("label").alias("topic_id"))
    segs = searchable(spark, d)
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("sentence_index"), "text", (F.col("conv_id") * 8 + F.col("turn")).alias("id"))
    seg_vec = segs.select("segment_id", (F.col("segment_id") % 97).alias("segment_time")).join(vec, F.col("segment_id") == F.col("v"))
    sent_vec = turns.select("id", "segment_id").join(vec.drop("topic_id"), F.col("id") == F.col("v"))
    vector = query_vector(spark, d)
    out = api.run(api.Request("the of -license", limit=20, by_distance=False), api.Index(turns, segs, sent_vec, seg_vec), lambda _: vector)
    nested = F.array_join(F.transform("sentences", lambda s: F.concat(s["sentence_index"].cast("string"), F.lit(":"), F.md5(s["text"]))), ",")
    return out.select("segment_id", F.round("score", 6).alias("score"), "signal_count", "signal_list", "match_type", F.md5("text").alias("text"), nested.alias("sentences"))


def enrich(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("sentence_index"), "text")
    results = turns.where("sentence_index = 0").select("segment_id").distinct()
    nested = search.enrich(results, turns.where(F.col("sentence_index") > 0))
    joined = F.array_join(F.transform("sentences", lambda s: F.concat(s["sentence_index"].cast("string"), F.lit(":"), F.md5(s["text"]))), ",")
    return nested.select("segment_id", F.size("sentences").alias("n"), joined.alias("sentences"))


def segment_sentences(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("sentence_index"), "role")
    return search.sentences_of(turns, turns.where((F.col("sentence_index") == 0) & (F.col("role") == "user")))


def segment_sentences_all(spark: SparkSession, d: str) -> DataFrame:
    """As segment_sentences, for every conversation that has a turn 0."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("sentence_index"), "role")
    return search.sentences_of(turns, turns.where(F.col("sentence_index") == 0))


SIM = f"list_cosine_similarity(embedding::double[], (SELECT v FROM {Q_SQL}))"
RANK = "round(({}) / 1.64493406685 / {}, 6)"


def _one(word: str) -> str:
    n = f"len(list_filter(t, lambda x: x = '{word}'))"
    return f"coalesce(list_sum(list_transform(range(1, {n} + 1), lambda j: 0.1::double / (j * j))), 0)"


def _rank(*words: str) -> str:
    return RANK.format(" + ".join(_one(w) for w in words), len(words))


DOCS = f"(SELECT doc_id AS segment_id, text, source AS station, {TOKENS_SQL} AS t FROM documents)"


def has(word: str) -> str:
    return f"list_contains(t, '{word}')"


CENTROIDS = "(SELECT label, i, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL)"


def penalty_sql(words: str = "w") -> str:
    repeats = f"(len({words}) - 3 > 0 AND (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, len({words}) - 2), lambda i: array_to_string({words}[i:i + 3], ' '))) AS g) GROUP BY g)) >= 3)"
    return f"""CASE WHEN len({words}) < 5 THEN 0.3::double WHEN len({words}) < 10 THEN 0.7::double ELSE 1.0::double END
 * CASE WHEN len({words}) >= 8 AND len(list_distinct({words})) / len({words}) < 0.3 THEN 0.2::double WHEN len({words}) >= 8 AND len(list_distinct({words})) / len({words}) < 0.4 THEN 0.5::double ELSE 1.0::double END
 * CASE WHEN len({words}) >= 12 AND {repeats} THEN 0.4::double ELSE 1.0::double END"""


TRGM = "list_distinct(flatten(list_transform({}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"

SQL = {
    "semantic_topk": f"SELECT vec_id AS id, round(s, 6) AS similarity FROM (SELECT vec_id, {SIM} AS s FROM embeddings) WHERE s > 0.18 ORDER BY s DESC, vec_id LIMIT 20",
    "semantic_topk_filtered": f"SELECT vec_id AS id, source AS station, label AS topic_id, round(s, 6) AS similarity FROM (SELECT vec_id, label, source, lang, {SIM} AS s FROM embeddings JOIN documents ON vec_id = doc_id) WHERE s > 0 AND source = 'src1' AND lang = 'en' ORDER BY s DESC, vec_id LIMIT 20",
    "semantic_direct": f"SELECT vec_id AS id, label AS topic_id, round(s, 6) AS similarity FROM (SELECT vec_id, label, {SIM.replace(Q_SQL, Q_SQL.replace('= 0', '= 1'))} AS s FROM embeddings) WHERE s > 0.25 ORDER BY s DESC, vec_id LIMIT 20",
    "topic_segments": f"WITH hit AS (SELECT label FROM (SELECT vec_id, label, {SIM} AS s FROM embeddings) WHERE s > 0.18 ORDER BY s DESC, vec_id LIMIT 3) SELECT vec_id AS id, label AS topic_id FROM embeddings WHERE label IN (SELECT label FROM hit) ORDER BY vec_id DESC LIMIT 20",
    "search_expanded": f"""WITH s AS (SELECT vec_id, label, {SIM} AS s FROM embeddings), near AS (SELECT * FROM s WHERE s > 0.18),
hit AS (SELECT * FROM near ORDER BY s DESC, vec_id LIMIT 5), topic AS (SELECT label FROM near GROUP BY label ORDER BY max(s) DESC, label LIMIT 5)
SELECT vec_id AS id, label AS topic_id, round(s, 6) AS similarity, 'direct' AS match_type FROM hit
UNION ALL (SELECT vec_id, label, round(s, 6), 'topic' FROM s WHERE label IN (FROM topic) AND vec_id NOT IN (SELECT vec_id FROM hit) ORDER BY s DESC, vec_id LIMIT 20)""",
    "topic_centroid": f"SELECT label AS topic_id, n AS members, i::int AS i, round(x, 6) AS x FROM {CENTROIDS}",
    "nearest_topic": f"SELECT label AS topic_id, round(s, 6) AS similarity FROM (SELECT label, list_cosine_similarity(list(x ORDER BY i), (SELECT v FROM {Q_SQL})) AS s FROM {CENTROIDS} GROUP BY label) WHERE s >= 0.05 ORDER BY s DESC, label LIMIT 1",
    "running_centroid": f"SELECT label AS topic_id, n + (label = 1)::int AS segment_count, i::int AS i, round(CASE WHEN label = 1 THEN (x * n + (SELECT v FROM {Q_SQL})[i + 1]) / (n + 1) ELSE x END, 6) AS x FROM {CENTROIDS}",
    "weighted_centroid": "SELECT label AS topic_id, i::int AS i, round(sum(x * w) / sum(w), 6) AS x FROM (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL",
    "keyword_plain": f"SELECT segment_id, {_rank('the', 'of')} AS rank FROM {DOCS} WHERE {has('the')} AND {has('of')} ORDER BY {_rank('the', 'of').replace('round', '').replace(', 6', '')} DESC, segment_id LIMIT 20",
    "keyword_or": f"SELECT segment_id, {_rank('einer', 'para')} AS rank FROM {DOCS} WHERE {has('einer')} OR {has('para')} ORDER BY {_rank('einer', 'para').replace('round', '').replace(', 6', '')} DESC, segment_id LIMIT 30",
    "keyword_not": f"SELECT segment_id, {_rank('the')} AS rank FROM {DOCS} WHERE {has('the')} AND NOT {has('of')} AND NOT {has('was')} ORDER BY {_rank('the').replace('round', '').replace(', 6', '')} DESC, segment_id LIMIT 30",
    "keyword_phrase": f"SELECT segment_id, {_rank('of', 'the', 'in')} AS rank FROM {DOCS} WHERE {has('in')} AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AND station = 'src1' ORDER BY {_rank('of', 'the', 'in').replace('round', '').replace(', 6', '')} DESC, segment_id LIMIT 30",
    "trigram_topk": f"""WITH g AS (SELECT segment_id, {TRGM.format('t')} AS g FROM {DOCS}), q AS (SELECT {TRGM.format("['the','of','and','in','to','with']")} AS q),
s AS (SELECT segment_id, len(list_intersect(g, q)) AS c, len(g) AS n, len(q) AS m FROM g, q)
SELECT segment_id, round(c / (n + m - c)::double, 6) AS similarity FROM s WHERE c / (n + m - c)::double >= 0.05 ORDER BY c / (n + m - c)::double DESC, segment_id LIMIT 20""",
    "index_tokens": f"SELECT token, count(*) AS occurrences, count(DISTINCT segment_id) AS segments FROM (SELECT segment_id, unnest(t) AS token FROM {DOCS}) GROUP BY token",
    "hybrid_rrf": f"""WITH docs AS (SELECT *, {WORDS_SQL} AS w FROM {DOCS}),
he AS (SELECT d.segment_id, s, row_number() OVER (ORDER BY s DESC, d.segment_id) AS r FROM (SELECT vec_id, {SIM} AS s FROM embeddings) e JOIN docs d ON d.segment_id = e.vec_id WHERE s > 0.18 QUALIFY r <= 40),
kw AS (SELECT segment_id, {_rank('the', 'of').replace('round', '').replace(', 6', '')} AS s, row_number() OVER (ORDER BY {_rank('the', 'of').replace('round', '').replace(', 6', '')} DESC, segment_id) AS r FROM docs WHERE {has('the')} AND {has('of')} QUALIFY r <= 40),
parts AS (SELECT segment_id, 'seg_he' AS signal, 0 AS pos, r, 0.8 * least(greatest(s / 0.5, 0.3), 1.0) / (60 + r) AS p FROM he WHERE (SELECT max(s) FROM he) >= 0.25
  UNION ALL SELECT segment_id, 'seg_kw', 1, r, 1.5 * least(greatest(s / 0.5, 0.3), 1.0) / (60 + r) FROM kw),
fused AS (SELECT segment_id, sum(p) AS raw, count(*) AS n, string_agg(signal, '+' ORDER BY signal) AS names, min(pos) AS pos, arg_min(r, pos) AS r FROM parts GROUP BY segment_id),
scored AS (SELECT f.*, d.text, raw * {penalty_sql('d.w')} AS score FROM fused f JOIN docs d USING (segment_id)),
kept AS (SELECT * FROM scored WHERE (SELECT max(score) FROM scored) >= 0.008 AND score >= greatest(0.008, (SELECT max(score) FROM scored) * 0.15) ORDER BY score DESC, pos, r, segment_id LIMIT 20)
SELECT segment_id, round(score, 6) AS score, n::int AS signal_count, names AS signal_list, CASE WHEN n > 1 THEN 'hybrid' ELSE names END AS match_type FROM kept WHERE NOT contains(lower(text), 'license')""",
    "hybrid_search": f"""WITH seg AS (SELECT doc_id AS id, doc_id AS segment_id, text, {TOKENS_SQL} AS t, list_cosine_similarity(e.embedding::double[], (SELECT v FROM {Q_SQL})) AS s, label, doc_id % 97 AS time FROM documents LEFT JOIN embeddings e ON vec_id = doc_id),
sent AS (SELECT conv_id * 8 + turn AS id, conv_id AS segment_id, text, {TOKENS_SQL} AS t, list_cosine_similarity(e.embedding::double[], (SELECT v FROM {Q_SQL})) AS s FROM conversations LEFT JOIN embeddings e ON vec_id = conv_id * 8 + turn),
he AS (SELECT 0 AS pos, 'sent_he' AS signal, id, segment_id, text, s, NULL AS label, 0.7 AS w FROM sent WHERE s > 0.18 UNION ALL SELECT 1, 'seg_he', id, segment_id, text, s, label, 0.8 FROM seg WHERE s > 0.18),
he_top AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY s DESC, id) AS r, max(s) OVER (PARTITION BY signal) AS best FROM he QUALIFY r <= 40 AND best >= 0.25),
kw AS (SELECT 2 AS pos, 'sent_kw' AS signal, id, segment_id, text, {_rank('the', 'of').replace('round', '').replace(', 6', '')} AS s FROM sent WHERE {has('the')} AND {has('of')} AND NOT {has('license')}
  UNION ALL SELECT 3, 'seg_kw', id, segment_id, text, {_rank('the', 'of').replace('round', '').replace(', 6', '')} FROM seg WHERE {has('the')} AND {has('of')} AND NOT {has('license')}),
kw_top AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY s DESC, id) AS r FROM kw QUALIFY r <= 40),
topics AS (SELECT label FROM he_top WHERE label IS NOT NULL GROUP BY label ORDER BY min(r), label LIMIT 10),
around AS (SELECT id, segment_id, text, row_number() OVER (ORDER BY time DESC, segment_id) AS r FROM seg WHERE label IN (FROM topics) QUALIFY r <= 40),
parts AS (SELECT pos, signal, segment_id, text, r, w * least(greatest(s / 0.5, 0.3), 1.0) / (60 + r) AS p FROM he_top
  UNION ALL SELECT pos, signal, segment_id, text, r, 1.5 * least(greatest(s / 0.5, 0.3), 1.0) / (60 + r) FROM kw_top UNION ALL SELECT 4, 'topic', segment_id, text, r, 0.15 / (60 + r) FROM around),
firsts AS (FROM parts QUALIFY row_number() OVER (PARTITION BY signal, segment_id ORDER BY r) = 1),
fused AS (SELECT segment_id, sum(p) AS raw, count(*) AS n, string_agg(signal, '+' ORDER BY signal) AS names, min(pos) AS pos, arg_min(r, pos) AS r, arg_min(text, pos) AS text, arg_min(signal, pos) AS lead FROM firsts GROUP BY segment_id),
scored AS (SELECT *, raw * {penalty_sql('w')} AS score FROM (SELECT *, {WORDS_SQL} AS w FROM fused)),
kept AS (SELECT * FROM scored WHERE (SELECT max(score) FROM scored) >= 0.008 AND score >= greatest(0.008, (SELECT max(score) FROM scored) * 0.15) ORDER BY score DESC, pos, r, segment_id LIMIT 20)
SELECT segment_id, round(score, 6) AS score, n::int AS signal_count, names AS signal_list, CASE WHEN n > 1 THEN 'hybrid' ELSE lead END AS match_type, md5(text) AS text,
  coalesce((SELECT string_agg(turn::varchar || ':' || md5(c.text), ',' ORDER BY turn) FROM conversations c WHERE c.conv_id = kept.segment_id), '') AS sentences FROM kept WHERE NOT contains(lower(text), 'license')""",
    "enrich": "SELECT c.segment_id, count(s.turn)::int AS n, coalesce(string_agg(s.turn::varchar || ':' || md5(s.text), ',' ORDER BY s.turn), '') AS sentences FROM (SELECT DISTINCT conv_id AS segment_id FROM conversations WHERE turn = 0) c LEFT JOIN conversations s ON s.conv_id = c.segment_id AND s.turn > 0 GROUP BY c.segment_id",
    "segment_sentences": "SELECT conv_id AS segment_id, turn AS sentence_index, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user')",
    "segment_sentences_all": "SELECT conv_id AS segment_id, turn AS sentence_index, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)",
}

QUERIES = {f.__name__: f for f in (semantic_topk, semantic_topk_filtered, semantic_direct, topic_segments, search_expanded, topic_centroid, nearest_topic, running_centroid, weighted_centroid, keyword_plain, keyword_or, keyword_not, keyword_phrase, trigram_topk, index_tokens, hybrid_rrf, hybrid_search, enrich, segment_sentences, segment_sentences_all)}
