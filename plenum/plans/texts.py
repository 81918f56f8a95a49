"""Queries of text operators: cleaning, sentences, turns, noise and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import constants as C
from plenum.functions import text as T
from plenum.operators import indexing, noise, stats
from plenum.plans.base import WORDS_SQL, table
from plenum.plans.searches import penalty_sql


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def quality_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(T.quality_penalty(F.col("text")), 6).alias("penalty"))


def noise_segment(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.noise_segment(F.col("text")).alias("noise_type"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Documents as recordings whose length in seconds is their number of characters."""
    rows = _docs(spark, d).select("doc_id", "text", F.lit(0.0).alias("start"), F.length("text").cast("double").alias("end"))
    return indexing.sentences(rows, ["doc_id"])


def noise_sentence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", T.noise_sentence(F.col("text")).alias("noise_type"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean_asr(F.col("text")).alias("text"), T.is_junk(F.col("text")).alias("junk"))


def sentence_times(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning uses back references, which the SQL engine's patterns lack; it is checked against Python in tests."""
    return _sentences(spark, d).select("doc_id", "part", "start", "end", F.length("text").alias("chars"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """The split alone, over uncleaned texts."""
    parts = F.split("text", r"(?<=[.?!।])\s+")
    rows = _docs(spark, d).select("doc_id", F.posexplode(parts).alias("part", "text"))
    return rows.select("doc_id", "part", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text", F.col("role").alias("speaker"), F.lit(0.5).alias("speaker_confidence"))
    return indexing.turns(rows, "conv_id").select("conv_id", "turn", "speaker", "start", "end", F.md5("text").alias("digest"), "speaker_confidence")


def event_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("position"), F.col("event_id").cast("double").alias("start"), F.col("event_id").cast("double").alias("end"), F.col("event_id").cast("string").alias("text"), F.col("event_type").alias("speaker"), F.col("value").alias("speaker_confidence"))
    return indexing.turns(rows, "user_id").select("user_id", "turn", "speaker", "start", "end", "text", F.round("speaker_confidence", 6).alias("speaker_confidence"))


#: Texts of the tables have no Hebrew, so some are spelt with Hebrew letters, one for each Latin one.
LATIN, HEBREW = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתםןףץ"
#: What is said in between, so that advertisement and jingle rules have something to find.
SAID = ("", *C.INDEX_AD_PHRASES, *C.FILTER_AD_PHRASES, *C.SEGMENT_AD_PHRASES, *C.STATION_JINGLES, *C.FILTER_JINGLES, C.TOO_LOW, C.BRANDS[0], f"{C.TOO_LOW} {C.BRANDS[1]}", f"{C.LOWEST_PRICES} {C.LOWEST_PRICES}", f"6,990 שקלים ועוד 990 {C.SHEKELS}", "1200 שקל")


def affix_expand(spark: SparkSession, d: str) -> DataFrame:
    """Conversations spelt with Hebrew letters; every fifth turn stays Latin."""
    spelt = F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(F.translate(F.lower("text"), LATIN, HEBREW))
    rows = table(spark, d, "conversations").select("conv_id", "turn", spelt.alias("text"))
    return rows.select("conv_id", "turn", F.md5(T.affix_expand(F.col("text"))).alias("expanded"), F.md5(T.prefix_expand(F.col("text"))).alias("prefixes"))


def noise_cases(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the conversations, two of three spelt with Hebrew letters, each with one of ``SAID`` before and one
    behind it: advertisement, jingle and noise rules."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("i", "piece"))
    h = F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("i")
    spelt = F.when(h % 3 == 0, F.col("piece")).otherwise(F.translate(F.lower("piece"), LATIN, HEBREW))
    said = lambda n: F.element_at(F.lit(list(SAID)), (n % len(SAID) + 1).cast("int"))
    rows = rows.select("conv_id", "turn", "i", F.concat_ws(" ", said(h), spelt, said(h * 5 + 3)).alias("text"))
    text = F.col("text")
    return rows.select("conv_id", "turn", "i", T.noise_segment(text).alias("noise_type"), T.is_ad_index(text).alias("ad_index"), T.is_ad_filter(text).alias("ad_filter"), T.is_jingle(text).alias("jingle"), F.round(T.hebrew_ratio(text), 6).alias("hebrew"))


def noise_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).withColumn("noise_type", T.noise_segment(F.col("text")))
    rows = rows.select(F.col("source").alias("station"), F.col("doc_id").alias("media_id"), F.col("noise_type").isNotNull().alias("is_noise"))
    return stats.noise_by_station(rows)


def noise_types(spark: SparkSession, d: str) -> DataFrame:
    return stats.noise_by_type(_docs(spark, d).withColumn("noise_type", T.noise_segment(F.col("text"))).withColumn("is_noise", F.col("noise_type").isNotNull()))


def noise_propagate(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as sentences of segments of three."""
    rows = table(spark, d, "labels").select((F.col("doc_id") / 3).cast("long").alias("segment_id"), (F.col("quality") == 0).alias("is_noise"), F.when(F.col("quality") == 0, F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"))).alias("noise_type"))
    return noise.propagated(rows)


def highlight(spark: SparkSession, d: str) -> DataFrame:
    marked = T.highlight(F.col("text"), "License")
    return _docs(spark, d).where(F.col("text").ilike("%license%")).select("doc_id", F.md5(marked).alias("digest"), T.minutes(F.length("text") / 7).alias("at"))


_P, _X = "[" + ",".join(f"'{p}'" for p in C.PREFIXES) + "]", C.SUFFIXES
_STEM = "CASE " + " ".join(f"WHEN ends_with({{0}}, '{s}') AND length({{0}}) >= {len(s) + 2} THEN left({{0}}, length({{0}}) - {len(s)})" for s in _X) + " END"
_BARE = f"CASE WHEN length(w) >= 3 AND list_contains({_P}, left(w, 1)) THEN substr(w, 2) END"


def _held(names: tuple[str, ...], text: str = "text") -> str:
    """How many of the phrases a text holds."""
    return "(" + " + ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')::int" for p in names) + ")"


def _times(phrase: str) -> str:
    return f"((length(text) - length(replace(text, '{phrase}', ''))) // {len(phrase)})"


_SLOGAN = f"(contains(text, '{C.TOO_LOW}') AND {_held(C.BRANDS)} > 0)"
_SAID = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in SAID) + "]"
_HEARD = f"""(SELECT conv_id, turn, i, {_SAID}[h % {len(SAID)} + 1] || ' ' || CASE WHEN h % 3 = 0 THEN piece ELSE translate(lower(piece), '{LATIN}', '{HEBREW}') END || ' ' || {_SAID}[(h * 5 + 3) % {len(SAID)} + 1] AS text
  FROM (SELECT *, conv_id * 31 + turn * 7 + i AS h FROM (SELECT conv_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i FROM (SELECT *, string_split(text, '.') AS p FROM conversations))))"""
_REPEATS = "(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g) GROUP BY g)) >= 3"
_PRICE = f"regexp_matches(text, '{C.PRICE}')"
_NOISE = f"""(SELECT *, CASE WHEN len(w) < 5 THEN 'short' WHEN len(w) >= 8 AND len(list_distinct(w)) / len(w) < 0.3 THEN 'repetitive'
  WHEN len(w) >= 12 AND (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g) GROUP BY g)) >= 3 THEN 'repetitive'
  WHEN len(w) < 15 AND regexp_matches(text, '\\p{{L}}') THEN 'gibberish' END AS noise_type FROM (SELECT doc_id, text, source, {WORDS_SQL} AS w FROM documents))"""
_RUNS = """SELECT *, sum(new) OVER (PARTITION BY k ORDER BY o) AS g FROM (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY k ORDER BY o) IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS new FROM ({0}))"""


SQL = {
    "quality_penalty": f"SELECT doc_id, round({penalty_sql('w')}, 6) AS penalty FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)",
    "noise_segment": f"SELECT doc_id, noise_type FROM {_NOISE}",
    "noise_sentence": f"SELECT conv_id, turn, CASE WHEN len(w) < 2 THEN 'short' WHEN len(w) >= 6 AND len(list_distinct(w)) / len(w) < 0.3 THEN 'repetitive' END AS noise_type FROM (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations)",
    "sentence_split": r"SELECT doc_id, (i - 1)::int AS part, length(p)::int AS chars, md5(p) AS digest FROM (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.?!।])\s+', '\1' || chr(31), 'g'), chr(31)) AS p FROM documents))",
    "speaker_turns": f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1)::int AS turn, speaker, start, \"end\", digest, 0.5::double AS speaker_confidence FROM (SELECT k AS conv_id, g, any_value(v) AS speaker, min(o)::double AS start, (max(o) + 1)::double AS \"end\", md5(string_agg(trim(text), ' ' ORDER BY o)) AS digest FROM ({_RUNS.format('SELECT conv_id AS k, turn AS o, role AS v, text FROM conversations')}) GROUP BY k, g)",
    "event_turns": f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY g) - 1)::int AS turn, speaker, start, \"end\", text, speaker_confidence FROM (SELECT k AS user_id, g, any_value(v) AS speaker, arg_min(event_id, o)::double AS start, arg_max(event_id, o)::double AS \"end\", string_agg(event_id::varchar, ' ' ORDER BY o) AS text, round(min(coalesce(value, 0)), 6) AS speaker_confidence FROM ({_RUNS.format('SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type AS v, event_id, value FROM events')}) GROUP BY k, g)",
    "affix_expand": f"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN text ELSE translate(lower(text), '{LATIN}', '{HEBREW}') END AS text FROM conversations),
w AS (SELECT conv_id, turn, text, list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) >= 3 THEN [{_BARE}, {_STEM.format('w')}, {_STEM.format(f'({_BARE})')}] ELSE [] END) AS f, list_transform(string_split(text, ' '), lambda w: {_BARE}) AS p FROM c)
SELECT conv_id, turn, md5(array_to_string(list_concat([text], list_filter(flatten(f), lambda x: x IS NOT NULL)), ' ')) AS expanded, md5(array_to_string(list_concat([text], list_filter(p, lambda x: x IS NOT NULL)), ' ')) AS prefixes FROM w""",
    "noise_cases": f"""WITH s AS (SELECT *, {WORDS_SQL} AS w, len(regexp_extract_all(text, '[֐-׿]')) AS he, len(regexp_extract_all(text, '\\p{{L}}')) AS letters FROM {_HEARD})
SELECT conv_id, turn, i::int AS i, CASE WHEN len(w) < 5 THEN 'short' WHEN len(w) >= 8 AND len(list_distinct(w)) / len(w) < 0.3 THEN 'repetitive' WHEN len(w) >= 12 AND {_REPEATS} THEN 'repetitive'
    WHEN len(w) < 15 AND letters > 0 AND he / letters < 0.3 THEN 'gibberish'
    WHEN {_held(C.SEGMENT_AD_PHRASES)} >= 2 OR {_held(C.SEGMENT_AD_PHRASES)} >= 1 AND {_PRICE} OR {_times(C.LOWEST_PRICES)} >= 2 OR {_SLOGAN} THEN 'commercial'
    WHEN len(w) <= 8 AND {_held(C.STATION_JINGLES)} > 0 THEN 'jingle' END AS noise_type,
  {_held(C.INDEX_AD_PHRASES, 'lower(text)')} >= 2 OR {_held(C.INDEX_AD_PHRASES, 'lower(text)')} >= 1 AND {_PRICE} OR {_times(C.LOWEST_PRICES)} >= 2 OR {_times(C.SHEKELS)} >= 2 AND {_PRICE} OR {_SLOGAN} AS ad_index,
  {_held(C.FILTER_AD_PHRASES, 'lower(text)')} >= 2 AS ad_filter, len(w) <= 8 AND {_held(C.STATION_JINGLES)} > 0 AS jingle,
  CASE WHEN letters > 0 THEN round(he / letters, 6) END AS hebrew FROM s""",
    "noise_stats": f"SELECT source AS station, count(*) AS total, count(noise_type) AS noise, round(100.0 * count(noise_type) / count(*), 4)::double AS noise_pct, count(DISTINCT CASE WHEN noise_type IS NOT NULL THEN doc_id END) AS noisy_media FROM {_NOISE} GROUP BY source",
    "noise_types": f"SELECT noise_type, count(*) AS n FROM {_NOISE} WHERE noise_type IS NOT NULL GROUP BY noise_type",
    "noise_propagate": """WITH s AS (SELECT doc_id // 3 AS segment_id, quality = 0 AS noisy, CASE WHEN quality = 0 THEN 't' || (doc_id % 2)::varchar END AS t FROM labels),
m AS (SELECT segment_id, t, row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, t) AS r FROM s WHERE t IS NOT NULL GROUP BY segment_id, t)
SELECT a.segment_id, a.n AS is_noise, CASE WHEN a.n THEN m.t END AS noise_type FROM (SELECT segment_id, bool_and(coalesce(noisy, false)) AS n FROM s GROUP BY segment_id) a LEFT JOIN m ON m.segment_id = a.segment_id AND m.r = 1""",
    "highlight": r"SELECT doc_id, md5(regexp_replace(text, '(license)', '<mark>\1</mark>', 'gi')) AS digest, (floor(floor(length(text) / 7) / 60)::int)::varchar || ':' || lpad((floor(length(text) / 7)::int % 60)::varchar, 2, '0') AS at FROM documents WHERE text ILIKE '%license%'",
}
QUERIES = {f.__name__: f for f in (quality_penalty, noise_segment, noise_sentence, clean_text, sentence_times, sentence_split, speaker_turns, event_turns, affix_expand, noise_cases, noise_stats, noise_types, noise_propagate, highlight)}
