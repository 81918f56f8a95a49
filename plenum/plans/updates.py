"""Queries of tables that are updated by key: links and noise flags written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import links, noise, phrases
from plenum.plans.base import WORDS_SQL, table
from plenum.sources import store
from plenum.sources.keyed import KeyedTable


#: These tables are small.
BUCKETS = 8


def _tables(spark: SparkSession, d: str, more: dict | None = None) -> tuple[KeyedTable, KeyedTable]:
    """Conversations as recordings: a turn is a sentence, three turns are a segment; not linked yet."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("sentence_index"), "text", *(c.alias(n) for n, c in (more or {}).items()))
    own = turns.withColumn("segment_id", F.concat_ws("-", "media_id", F.floor(F.col("sentence_index") / 3)))
    none = {"is_noise": F.lit(None).cast("boolean"), "noise_type": F.lit(None).cast("string")}
    segments = own.groupBy("media_id", "segment_id").agg(F.count("*").alias("sentence_count")).withColumns({"topic_id": F.lit(None).cast("int"), **none})
    made = []
    for name, rows in (("sentences", turns.withColumn("segment_id", F.lit(None).cast("string")).withColumns(none)), ("segments", segments)):
        made.append(KeyedTable(spark, store.fresh(spark, name), "media_id", BUCKETS).create(rows))
    links.link_segments(made[0], own)
    return made[0], made[1]


def segment_links(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as linked to their segments."""
    return _tables(spark, d)[0].read().select("media_id", "sentence_index", "segment_id")


def topic_links(spark: SparkSession, d: str) -> DataFrame:
    """Segments as linked to topics: the number of their sentences stands for the topic."""
    _, segments = _tables(spark, d)
    links.link_topics(segments, segments.read().withColumn("topic_id", F.col("sentence_count").cast("int")))
    return segments.read().select("media_id", "segment_id", "topic_id")


def noise_writeback(spark: SparkSession, d: str) -> DataFrame:
    """Segments after their recordings' flags were set: turns without a question are commercial, short ones jingles.
    Only recordings in which some turn is detected are written."""
    sentences, segments = _tables(spark, d)
    text = F.col("text")
    kind = F.when(~text.contains("?") & (F.length(text) > 60), "commercial").when(F.length(text) < 40, "jingle")
    found = sentences.read().select("media_id", "sentence_index", kind.alias("noise_type")).where("noise_type IS NOT NULL")
    links.write_noise(sentences, segments, found)
    flagged = sentences.read().groupBy("media_id", "segment_id").agg(F.count_if("is_noise").alias("noisy"))
    return segments.read().join(flagged, ["media_id", "segment_id"]).select("media_id", "segment_id", "noisy", "is_noise", "noise_type")


#: Phrases that occur in the conversations.
PHRASES = noise.Phrases(("is the", "que la", "in die"), ("of the", " und ", "de la"), ("tion of", "lich", "and th", "the the", "that", "was "), ("in the", " no ", "ing "))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """The noise filter as a whole over conversations: a turn lasts ten seconds, longer ones are partly music; detected,
    flagged, handed on to segments of three turns, written back by recording."""
    sentences, segments = _tables(spark, d, {"start_time": F.col("turn") * 10.0, "end_time": F.col("turn") * 10.0 + 10})
    spans = table(spark, d, "conversations").where(F.length("text") > 700).select(F.col("conv_id").alias("media_id"), (F.col("turn") * 10.0 + 1).alias("s"), (F.col("turn") * 10.0 + 8).alias("e"), F.lit("music").alias("label"), F.col("turn").alias("span_index"))
    links.filter_noise(sentences, segments, spans, wanted=PHRASES)
    own = sentences.read().select("media_id", "segment_id", "sentence_index", "is_noise", "noise_type")
    parts = segments.read().select("media_id", "segment_id", F.col("is_noise").alias("segment_noise"), F.col("noise_type").alias("segment_type"))
    return own.join(parts, ["media_id", "segment_id"])


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many phrases of each list each document holds."""
    lists = {"opens": PHRASES.opens, "closes": PHRASES.closes, "ads": PHRASES.ads, "jingles": PHRASES.jingles}
    return phrases.counted(table(spark, d, "documents").select("doc_id", "text"), lists, F.lower("text")).drop("text")


_TURNS = "(SELECT *, conv_id || '-' || turn // 3 AS segment_id FROM conversations)"



def _held(names: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{p}')::int" for p in names) + ")"


SQL = {
    "phrase_counts": "SELECT doc_id, " + ", ".join(f"{_held(getattr(PHRASES, n))}::int AS {n}" for n in ("opens", "closes", "ads", "jingles")) + " FROM documents",
    "noise_filter": f"""WITH RECURSIVE c AS (SELECT conv_id AS m, turn AS i, segment_id AS g, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_held(PHRASES.opens)} > 0 AS opens, {_held(PHRASES.closes)} > 0 AS closes,
  {_held(PHRASES.ads)} >= 2 AS ad, len({WORDS_SQL.replace('text', 'lower(text)')}) < 20 AND {_held(PHRASES.jingles)} > 0 AS jingle, length(text) > 700 AS music FROM {_TURNS}),
fold AS (SELECT m, 0::bigint AS n, NULL::bigint AS begun, NULL::bigint AS a, NULL::bigint AS z FROM (SELECT DISTINCT m FROM c)
  UNION ALL SELECT c.m, c.n, CASE WHEN f.begun IS NULL THEN CASE WHEN c.opens THEN c.n END WHEN c.closes THEN NULL ELSE f.begun END, CASE WHEN c.closes THEN f.begun END, c.n FROM fold f JOIN c ON c.m = f.m AND c.n = f.n + 1),
b AS (SELECT m, a, z FROM fold WHERE a IS NOT NULL),
k AS (SELECT m, i, g, CASE WHEN ad OR EXISTS (SELECT 1 FROM b WHERE b.m = c.m AND c.n BETWEEN b.a AND b.z) THEN 'commercial' WHEN jingle THEN 'jingle' WHEN music THEN 'music' END AS kind FROM c),
t AS (SELECT *, bool_or(kind IS NOT NULL) OVER (PARTITION BY m) AS hit, count(kind) OVER (PARTITION BY m, g) = count(*) OVER (PARTITION BY m, g) AS whole FROM k),
best AS (SELECT m, g, kind FROM k WHERE kind IS NOT NULL GROUP BY m, g, kind QUALIFY row_number() OVER (PARTITION BY m, g ORDER BY count(*) DESC, kind) = 1)
SELECT t.m AS media_id, t.g AS segment_id, i AS sentence_index, CASE WHEN hit THEN t.kind IS NOT NULL END AS is_noise, t.kind AS noise_type, CASE WHEN hit THEN whole END AS segment_noise, CASE WHEN whole THEN best.kind END AS segment_type
FROM t LEFT JOIN best ON best.m = t.m AND best.g = t.g""",
    "segment_links": f"SELECT conv_id AS media_id, turn AS sentence_index, segment_id FROM {_TURNS}",
    "topic_links": f"SELECT conv_id AS media_id, segment_id, count(*)::int AS topic_id FROM {_TURNS} GROUP BY conv_id, segment_id",
    "noise_writeback": f"""WITH s AS (SELECT conv_id AS m, segment_id, CASE WHEN NOT contains(text, '?') AND length(text) > 60 THEN 'commercial' WHEN length(text) < 40 THEN 'jingle' END AS kind FROM {_TURNS}),
t AS (SELECT *, bool_or(kind IS NOT NULL) OVER (PARTITION BY m) AS hit FROM s),
c AS (SELECT m, segment_id, kind, count(*) AS n FROM t WHERE kind IS NOT NULL GROUP BY ALL),
best AS (SELECT m, segment_id, kind FROM c QUALIFY row_number() OVER (PARTITION BY m, segment_id ORDER BY n DESC, kind) = 1)
SELECT t.m AS media_id, t.segment_id, count(t.kind) AS noisy, CASE WHEN any_value(hit) THEN count(t.kind) = count(*) END AS is_noise,
       CASE WHEN count(t.kind) = count(*) THEN any_value(best.kind) END AS noise_type
FROM t LEFT JOIN best ON best.m = t.m AND best.segment_id = t.segment_id GROUP BY t.m, t.segment_id""",
}

QUERIES = {f.__name__: f for f in (segment_links, topic_links, noise_writeback, noise_filter, phrase_counts)}
