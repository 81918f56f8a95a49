"""Queries of intervals, statistics, state machines and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import constants as C
from plenum.functions import times
from plenum.functions import vector as V
from plenum.operators import indexing, intervals, noise, search, stats
from plenum.plans.base import Q_SQL, query_vector, table, vectors
from plenum.sources import documents


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as intervals to the next one, in seconds since 2020; the last one has none."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1577836800000000)) / 1e6
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", at.alias("start"), F.lead(at).over(by).alias("end"), F.row_number().over(by).alias("n"))
    return rows.where(F.col("end").isNotNull())


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of four events as segments, and every event as a turn."""
    rows = _events(spark, d).withColumn("media_id", F.col("user_id"))
    segs = rows.groupBy("media_id", F.floor((F.col("n") - 1) / 4).alias("segment_index")).agg((F.min("start") + 0.5).alias("start"), (F.max("end") + 100).alias("end"))
    return segs, rows.select("media_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("event_type").alias("speaker"), F.col("event_type").alias("label"), F.col("n").alias("span_index"))


def speaker_assign(spark: SparkSession, d: str) -> DataFrame:
    segs, turns = _sides(spark, d)
    out = intervals.assign_speakers(segs, turns.drop("label", "span_index"))
    return out.select("media_id", "segment_index", "speaker", F.round("speaker_confidence", 3).alias("confidence"))


def noise_overlap(spark: SparkSession, d: str) -> DataFrame:
    segs, turns = _sides(spark, d)
    return intervals.noisy_sentences(segs.withColumnRenamed("segment_index", "sentence_index"), turns.drop("speaker").where("label <> 'view'"))


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "start", (F.col("start") + (F.col("end") - F.col("start")) / 2).alias("end"), F.col("event_type").alias("label"))
    out = intervals.merge_adjacent(rows, "user_id", 3600.0)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "label")


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("bin"), F.col("event_type").alias("label"))
    return intervals.runs(rows, "user_id", 0.1, 0.2)


def label_durations(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "start", "end", intervals.class_label(F.when(F.col("event_type") == "view", "male").otherwise(F.col("event_type"))).alias("label"))
    return stats.label_durations(rows, ["user_id"]).select("user_id", "label", "segments", F.round("seconds", 3).alias("seconds"), "pct")


def loudness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"), (F.col("value") / 100000).alias("x"))
    return intervals.loudness(rows, "user_id", 4)


def speech_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"), F.when(F.col("event_type") == "view", 0.2).otherwise(0.8).alias("p"))
    return intervals.speech_spans(rows, "user_id", 16000, 512, 0.5, 64, 64)


def ad_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    kinds = F.col("event_type")
    return noise.in_break(rows, "user_id", "n", kinds == "purchase", kinds == "click")


def segment_group(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select((F.col("id") / 50).cast("long").alias("media_id"), F.col("id").alias("sentence_index"), (F.col("id") * 10).cast("double").alias("start"), (F.col("id") * 10 + 10).cast("double").alias("end"), "embedding_he")
    return indexing.segments(rows, similarity=0.1)


def topic_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("station", F.col("id") % 8)
    return indexing.topics(rows, "station", ["id"], threshold=0.25)


def topic_resume(spark: SparkSession, d: str) -> DataFrame:
    """The same topics in two runs, the second one from the table of topics that the first one has left."""
    rows = vectors(spark, d).withColumn("station", F.col("id") % 8)
    half = F.col("id") < rows.agg(F.max("id") / 2).first()[0]
    first = indexing.topics(rows.where(half), "station", ["id"], threshold=0.25, states=True)
    second = indexing.topics(rows.where(~half), "station", ["id"], threshold=0.25, known=indexing.topic_table(first, "station"))
    return first.select("station", "id", "topic").unionByName(second)


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recordings, lines as segments with their supplier as topic, parts of orders as sentences."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    media = orders.select(F.col("o_orderkey").alias("media_id"), F.col("o_orderpriority").alias("station"), F.col("o_orderstatus").alias("media_type"), F.col("o_orderdate").alias("segment_time"))
    segs = lines.select(F.col("l_orderkey").alias("media_id"), F.col("l_suppkey").alias("topic_id"))
    return stats.index_stats(media, segs, lines.where("l_quantity > 25").select(F.col("l_orderkey").alias("media_id")))


def hier_join_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts down a hierarchy: lines are counted by order before orders meet customers and nations."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.round(F.coalesce(F.sum("quantity"), F.lit(0.0)), 2).alias("quantity"))


def index_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("s3_transcript_key"), "c_name")
    return documents.not_indexed(docs, table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("s3_transcript_key")))


def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    new = old.where("s_suppkey % 3 = 0").withColumns({"s_name": F.upper("s_name"), "s_suppkey": F.col("s_suppkey") + 1})
    return documents.upsert(old, new, ["s_suppkey"])


def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = old.where("s_suppkey % 3 = 0").withColumns({"s_name": F.upper("s_name"), "s_suppkey": F.col("s_suppkey") + 40})
    return documents.upsert(old, new, ["s_suppkey"], ignore=True)


def noise_flags(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sentences of recordings of seven; only recordings with a detection are set anew."""
    rows = table(spark, d, "labels").select((F.col("doc_id") / 7).cast("long").alias("media_id"), F.col("doc_id").alias("sentence_index"), (F.col("quality") == 0).alias("is_noise"), F.when(F.col("quality") == 0, "short").alias("noise_type"))
    found = table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") / 7).cast("long").alias("media_id"), F.col("doc_id").alias("sentence_index"), F.lit("commercial").alias("noise_type"))
    return noise.flagged(rows, found)


def storage_events(spark: SparkSession, d: str) -> DataFrame:
    """Pages as storage events: a record with an encoded key, plain fields with or without a bucket, or neither."""
    kind, key = F.col("page_id") % 5, F.concat(F.replace("url", F.lit("https://"), F.lit("s3://")), F.lit(" _transcript.json"))
    encoded = F.replace(F.replace(key, F.lit(" "), F.lit("%20")), F.lit("?"), F.lit("%3F"))
    bucket = F.concat(F.lit("b"), F.col("page_id") % 3)
    record = F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(encoded.alias("key")).alias("object")).alias("s3"))
    body = F.when(kind == 0, F.to_json(F.struct(F.array(record).alias("Records")))).when(kind == 1, F.to_json(F.struct(key.alias("key")))).when(kind == 2, F.to_json(F.struct(bucket.alias("bucket"), encoded.alias("key")))).when(kind == 3, F.lit("{}")).otherwise(F.col("url"))
    found = documents.events(table(spark, d, "pages").select("page_id", body.alias("body")), default_bucket="main")
    uri_bucket, uri_key = times.uri_parts(F.coalesce("key", F.lit("")), "main")
    return found.select("page_id", "bucket", "key", uri_bucket.alias("uri_bucket"), uri_key.alias("uri_key"))


def key_times(spark: SparkSession, d: str) -> DataFrame:
    """Events as recordings: keys below radio stations and television channels, some without a stamp; times of both
    readings of a stamp, and of an offset behind it."""
    stamp = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.date_format("ts", "yyyy-MM-dd_HH-mm"))
    k = F.concat(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("tv/ch"), "user_id")).otherwise(F.concat(F.lit("st"), "user_id")), F.lit("/"), stamp, F.lit("_transcript.json"))
    rows = table(spark, d, "events").select("event_id", "value", k.alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("said"))
    k = F.col("k")
    utc, local = times.segment_time(k), times.recording_time(k, F.col("said"), F.lit(None).cast("string"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", times.station(k).alias("station"), times.media_type(times.station(k)).alias("media_type"), times.diarized_key(k).alias("diarized"), times.audio_key(k).alias("audio"), text(utc).alias("utc"), text(local).alias("local"), text(times.absolute(local, F.floor("value"))).alias("later"))


def vector_cases(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with broken numbers in a third of them each (none, not a number, infinite), and some of zeros alone."""
    odd = lambda x: F.when(F.col("id") % 5 == 0, F.lit(0.0)).when((F.col("id") % 3 == 1) & (x > 0.1), F.lit(float("nan"))).when((F.col("id") % 3 == 2) & (x < 0), F.lit(float("-inf"))).otherwise(x)
    rows = vectors(spark, d).select("id", F.transform(F.col("embedding_he").cast("array<double>"), odd).alias("v"))
    clean, q = V.sanitize(F.col("v")), V.literal(query_vector(spark, d))
    zero = F.transform(q, lambda x: x * 0)
    return rows.select("id", clean.isNull().alias("gone"), F.round(F.aggregate(F.coalesce(clean, zero), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.cosine(F.coalesce(clean, zero), q), 6).alias("cosine"))


def date_range(spark: SparkSession, d: str) -> DataFrame:
    """Every day between the first and the last order."""
    first, last = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return documents.dates(spark, first, last)


def newest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("topic_id"), F.col("o_orderdate").alias("segment_time"))
    return search.by_topic(rows, spark.createDataFrame([("F",), ("P",)], "topic_id string"), 25)


def on_day(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("segment_time"))
    first = rows.agg(F.to_date(F.min("segment_time")).cast("string")).first()[0]
    return search.on_day(rows, first).select("event_id")


def distinct_days(spark: SparkSession, d: str) -> DataFrame:
    return stats.days(table(spark, d, "events").select(F.col("ts").alias("segment_time")))


def noise_reset(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sentences of recordings of seven; those of recordings with a toxic one are cleared."""
    rows = table(spark, d, "labels").select((F.col("doc_id") / 7).cast("long").alias("media_id"), F.col("doc_id").alias("sentence_index"), (F.col("quality") == 0).alias("is_noise"), F.when(F.col("quality") == 0, "short").alias("noise_type"), "toxic")
    return noise.reset(rows, rows.where("toxic = 1")).drop("toxic")


def label_bins(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as recordings of a second for each turn: user turns are heard as speech, and the classifier calls
    long turns music and others noise, for longer than the recording lasts."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.55).alias("end"), "role", F.when(F.length("text") > 200, "music").otherwise("noise").alias("label"), F.col("turn").alias("span_index"))
    media = turns.groupBy("media_id").agg((F.max("start") + 1).alias("duration"))
    return intervals.label_bins(turns.where("role = 'user'"), turns.where("role <> 'user'"), media, "media_id", True)


_E = "(SELECT *, (epoch_us(ts) - 1577836800000000) / 1e6 AS s, (epoch_us(lead(ts) OVER w) - 1577836800000000) / 1e6 AS e, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_SEG = f"(SELECT user_id AS m, (n - 1) // 4 AS i, min(s) + 0.5 AS a, max(e) + 100 AS b FROM {_E} WHERE e IS NOT NULL GROUP BY ALL)"
_PAIR = f"(SELECT g.m, g.i, g.a, g.b, t.s, t.e, t.n, t.event_type AS k, least(b, e) - greatest(a, s) AS o FROM {_SEG} g JOIN {_E} t ON t.user_id = g.m AND t.e IS NOT NULL AND g.a < t.e AND t.s < g.b)"
#: Rows in order, and the states of a fold over them: one recursion step handles the next row of every key.
_CUES = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'purchase' AS opens, event_type = 'click' AS closes FROM events)"
_UNITS = "(SELECT vec_id AS id, embedding::double[] AS v, {0} AS k, row_number() OVER (PARTITION BY {0} ORDER BY vec_id) AS n FROM embeddings)"
_MEAN = "list_transform(range(1, len(v) + 1), lambda i: list_avg(list_transform(members, lambda m: m[i])))"
_R = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
SQL = {
    "speaker_assign": f"""WITH s AS (SELECT m, i, k, sum(o) AS o, min(s) AS f, any_value(b - a) AS len FROM {_PAIR} GROUP BY m, i, k),
r AS (SELECT *, row_number() OVER (PARTITION BY m, i ORDER BY o DESC, f, k DESC) AS r FROM s)
SELECT g.m AS media_id, g.i AS segment_index, coalesce(k, 'UNKNOWN') AS speaker, coalesce(round(o / (b - a), 3), 0) AS confidence FROM {_SEG} g LEFT JOIN r ON r.m = g.m AND r.i = g.i AND r.r = 1""",
    "noise_overlap": f"""SELECT m AS media_id, i AS sentence_index, coalesce(arg_max(k, n) FILTER (WHERE o > 0.3 * (b - a)), 'noise') AS noise_type
FROM {_PAIR} WHERE k <> 'view' AND b > a GROUP BY m, i HAVING sum(o) > 0.5 * max(b - a)""",
    "merge_adjacent": f"""WITH r AS (SELECT user_id, event_type AS label, s, s + (e - s) / 2 AS e FROM {_E} WHERE e IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(label) OVER w = label AND s - lag(e) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM f)
SELECT user_id, round(min(s), 3) AS start, round(arg_max(e, s), 3) AS "end", any_value(label) AS label FROM g GROUP BY user_id, g""",
    "label_runs": f"""WITH r AS (SELECT user_id, {_R} - 1 AS b, event_type AS label FROM events),
f AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY b)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY b) AS g FROM f),
s AS (SELECT user_id, any_value(label) AS label, round(min(b) * 0.1::double, 3) AS s, round((max(b) + 1) * 0.1::double, 3) AS e FROM g GROUP BY user_id, g HAVING count(*) * 0.1::double >= 0.2::double),
f2 AS (SELECT *, CASE WHEN lag(label) OVER w = label AND s - lag(e) OVER w <= 1.0 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
g2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM f2)
SELECT user_id, min(s) AS start, max(e) AS "end", any_value(label) AS label FROM g2 GROUP BY user_id, g""",
    "label_durations": f"""WITH r AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'speech' ELSE 'noise' END AS label, e - s AS d FROM {_E} WHERE e IS NOT NULL)
SELECT user_id, label, count(*) AS segments, round(sum(d), 3) AS seconds, CASE WHEN any_value(t) > 0 THEN round(100 * sum(d) / any_value(t), 2) ELSE 0 END AS pct FROM r JOIN (SELECT user_id, sum(d) AS t FROM r GROUP BY user_id) USING (user_id) GROUP BY user_id, label""",
    "loudness": f"""WITH r AS (SELECT user_id, {_R} - 1 AS i, value / 100000 AS x FROM events), w AS (SELECT user_id, i // 8 AS w, sum(x * x) AS s, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, round(w * 8 / 4, 3) AS start, round((w * 8 + n) / 4, 3) AS "end", round(20 * log10(sqrt(s / n) + 1e-10), 6) AS db, CASE WHEN 20 * log10(sqrt(s / n) + 1e-10) < -35 THEN 'silence' ELSE 'music' END AS label FROM w""",
    "speech_spans": f"""WITH f AS (SELECT user_id, {_R} - 1 AS i, event_type <> 'view' AS loud FROM events),
m AS (SELECT *, CASE WHEN lag(loud) OVER (PARTITION BY user_id ORDER BY i) IS NOT DISTINCT FROM loud THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT user_id, any_value(loud) AS loud, min(i) AS a, max(i) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS g FROM m) GROUP BY user_id, g),
p AS (SELECT *, max(z) OVER (PARTITION BY user_id) AS last, NOT loud AND (z - a) * 512 >= 1024 AS pause FROM r),
q AS (SELECT *, count(*) FILTER (WHERE pause) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM p),
s AS (SELECT user_id, min(a) FILTER (WHERE loud) AS a, coalesce(min(a) FILTER (WHERE pause), max(last) FILTER (WHERE NOT loud AND z = last), max(last) + 1) AS z FROM q GROUP BY user_id, g)
SELECT user_id, a * 512 AS start, z * 512 AS "end" FROM s WHERE a IS NOT NULL AND (z - a) * 512 >= 1024""",
    "ad_spans": f"""WITH RECURSIVE c AS {_CUES},
fold AS (SELECT user_id, 0::bigint AS n, NULL::bigint AS begun, NULL::bigint AS a, NULL::bigint AS z FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL SELECT c.user_id, c.n, CASE WHEN f.begun IS NULL THEN CASE WHEN c.opens THEN c.n END WHEN c.closes OR c.n - f.begun > {noise.LONGEST_BREAK} THEN NULL ELSE f.begun END,
    CASE WHEN c.closes OR c.n - f.begun > {noise.LONGEST_BREAK} THEN f.begun END, CASE WHEN c.closes THEN c.n ELSE c.n - 1 END
  FROM fold f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1),
b AS (SELECT user_id, a, z FROM fold WHERE a IS NOT NULL)
SELECT c.user_id, c.n::int AS n, bool_or(b.a IS NOT NULL) AS in_break FROM c LEFT JOIN b ON b.user_id = c.user_id AND c.n BETWEEN b.a AND b.z GROUP BY c.user_id, c.n""",
    "segment_group": f"""WITH RECURSIVE u AS {_UNITS.format('vec_id // 50')},
fold AS (SELECT k, 0::bigint AS n, NULL::bigint AS id, -1 AS segment, []::double[][] AS members, 0.0::double AS begun, 0 AS held FROM (SELECT DISTINCT k FROM u)
  UNION ALL SELECT k, n, id, CASE WHEN fresh THEN segment + 1 ELSE segment END, CASE WHEN fresh THEN [v] ELSE list_slice(list_append(members, v), greatest(1, len(members) + 2 - {C.SEGMENT_WINDOW}), len(members) + 1) END,
    CASE WHEN fresh THEN id * 10.0::double ELSE begun END, CASE WHEN fresh THEN 1 ELSE held + 1 END
  FROM (SELECT u.k, u.n, u.id, f.segment, f.members, f.begun, f.held, u.v, CASE WHEN len(f.members) = 0 THEN true ELSE u.id * 10 + 10 - f.begun >= {C.SEGMENT_SECONDS} OR f.held >= {C.SEGMENT_LEAST} AND list_cosine_similarity({_MEAN.replace('v)', 'u.v)').replace('members', 'f.members')}, u.v) < 0.1 END AS fresh
    FROM fold f JOIN u ON u.k = f.k AND u.n = f.n + 1))
SELECT k AS media_id, id AS sentence_index, segment AS segment_index FROM fold WHERE id IS NOT NULL""",
    "topic_assign": f"""WITH RECURSIVE u AS {_UNITS.format('vec_id % 8')},
fold AS (SELECT k, 0::bigint AS n, NULL::bigint AS id, -1 AS topic, []::double[][] AS centers, []::bigint[] AS counts FROM (SELECT DISTINCT k FROM u)
  UNION ALL SELECT k, n, id, CASE WHEN best IS NULL THEN len(centers)::int ELSE best - 1 END,
    CASE WHEN best IS NULL THEN list_append(centers, v) ELSE list_transform(centers, lambda c, i: CASE WHEN i = best THEN list_transform(c, lambda x, j: (x * counts[best] + v[j]) / (counts[best] + 1)) ELSE c END) END,
    CASE WHEN best IS NULL THEN list_append(counts, 1) ELSE list_transform(counts, lambda c, i: c + (i = best)::int) END
  FROM (SELECT *, CASE WHEN list_max(sims) >= 0.25 THEN list_position(sims, list_max(sims)) END AS best
    FROM (SELECT u.k, u.n, u.id, u.v, f.centers, f.counts, list_transform(f.centers, lambda c: list_cosine_similarity(c, u.v)) AS sims FROM fold f JOIN u ON u.k = f.k AND u.n = f.n + 1)))
SELECT k AS station, id, topic FROM fold WHERE id IS NOT NULL""",
    "index_stats": """WITH t AS (SELECT o_orderpriority AS station, o_orderstatus AS media_type, count(DISTINCT l_suppkey) AS topic_count, count(*) AS segment_count, count(*) FILTER (WHERE l_quantity > 25) AS sentence_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o.station, o.media_type, media_count, coalesce(segment_count, 0) AS segment_count, coalesce(sentence_count, 0) AS sentence_count, earliest, latest, coalesce(topic_count, 0) AS topic_count
FROM (SELECT o_orderpriority AS station, o_orderstatus AS media_type, count(*) AS media_count, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders GROUP BY ALL) o LEFT JOIN t USING (station, media_type)""",
    "hier_join_stats": """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines, round(coalesce(sum(l_quantity), 0), 2) AS quantity
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""",
    "index_skip": "SELECT c_custkey AS s3_transcript_key, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "upsert_replace": "WITH n AS (SELECT s_suppkey + 1 AS s_suppkey, upper(s_name) AS s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0) FROM n UNION ALL SELECT s_suppkey, s_name, round(s_acctbal, 2) FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n)",
    "upsert_ignore": "WITH n AS (SELECT s_suppkey + 40 AS s_suppkey, upper(s_name) AS s_name FROM supplier WHERE s_suppkey % 3 = 0) SELECT s_suppkey, s_name FROM supplier UNION ALL FROM n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "noise_flags": """WITH r AS (SELECT doc_id // 7 AS m, doc_id AS i, quality = 0 AS q, toxic = 1 AS t FROM labels)
SELECT m AS media_id, i AS sentence_index, CASE WHEN bool_or(t) OVER (PARTITION BY m) THEN t ELSE q END AS is_noise, CASE WHEN bool_or(t) OVER (PARTITION BY m) THEN CASE WHEN t THEN 'commercial' END WHEN q THEN 'short' END AS noise_type FROM r""",
    "storage_events": """WITH p AS (SELECT page_id, page_id % 5 AS kind, replace(url, 'https://', 's3://') || ' _transcript.json' AS k, 'b' || page_id % 3 AS b FROM pages),
e AS (SELECT page_id, CASE kind WHEN 0 THEN b WHEN 1 THEN 'main' WHEN 2 THEN b END AS bucket, CASE kind WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN replace(replace(k, ' ', '%20'), '?', '%3F') END AS key FROM p)
SELECT page_id, bucket, key, CASE WHEN starts_with(key, 's3://') THEN regexp_extract(key, '^s3://([^/]*)', 1) ELSE 'main' END AS uri_bucket,
  CASE WHEN starts_with(key, 's3://') THEN regexp_replace(key, '^s3://[^/]*/?', '') ELSE coalesce(key, '') END AS uri_key FROM e""",
    "key_times": """WITH k AS (SELECT event_id, value, date_trunc('second', ts) AS said, event_id % 7 <> 0 AS stamped, date_trunc('minute', ts) AS stamp, CASE WHEN user_id % 3 = 0 THEN 'tv/ch' ELSE 'st' END || user_id AS station,
  CASE WHEN event_id % 7 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m-%d_%H-%M') END AS name FROM events),
t AS (SELECT *, timezone('UTC', timezone('Asia/Jerusalem', CASE WHEN stamped THEN stamp ELSE said END)) AS begun FROM k)
SELECT event_id, station, CASE WHEN starts_with(station, 'tv/') THEN 'tv' ELSE 'radio' END AS media_type, station || '/' || name || '_diarized.json' AS diarized,
  station || '/' || name || CASE WHEN starts_with(station, 'tv/') THEN '.mp4' ELSE '.mp3' END AS audio, CASE WHEN stamped THEN strftime(stamp, '%Y-%m-%d %H:%M:%S') END AS utc,
  strftime(begun, '%Y-%m-%d %H:%M:%S') AS local, strftime(begun + to_seconds(floor(value)::bigint), '%Y-%m-%d %H:%M:%S') AS later FROM t""",
    "vector_cases": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding::double[], lambda x: CASE WHEN vec_id % 5 = 0 OR vec_id % 3 = 1 AND x > 0.1::float OR vec_id % 3 = 2 AND x < 0 THEN 0.0::double ELSE x END) AS v FROM embeddings)
SELECT id, list_max(list_transform(v, lambda x: abs(x))) = 0 AS gone, round(list_sum(v), 6) AS total,
  CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 0.0::double ELSE round(list_cosine_similarity(v, (SELECT v FROM {Q_SQL})), 6) END AS cosine FROM v""",
    "date_range": "SELECT range::date AS day FROM (SELECT min(o_orderdate)::date AS a, max(o_orderdate)::date AS b FROM orders), range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)",
    "on_day": "SELECT event_id FROM events WHERE ts::date = (SELECT min(ts)::date FROM events)",
    "distinct_days": "SELECT ts::date AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "noise_reset": """WITH r AS (SELECT doc_id // 7 AS m, doc_id AS i, quality = 0 AS q, bool_or(coalesce(toxic = 1, false)) OVER (PARTITION BY doc_id // 7) AS hit FROM labels)
SELECT m AS media_id, i AS sentence_index, CASE WHEN hit THEN false ELSE q END AS is_noise, CASE WHEN NOT hit AND q THEN 'short' END AS noise_type FROM r""",
    "label_bins": """WITH t AS (SELECT conv_id AS m, turn, turn * 10 AS a, trunc((turn + 1.55::double) / 0.1::double)::int AS b, role = 'user' AS heard, CASE WHEN length(text) > 200 THEN 'music' ELSE 'noise' END AS label FROM conversations),
bins AS (SELECT m, unnest(range(0, trunc((max(turn) + 1) / 0.1::double)::int + 1)) AS bin FROM t GROUP BY m),
seen AS (SELECT bins.m, bins.bin, coalesce(bool_or(heard), false) AS heard, arg_max(label, turn) FILTER (WHERE NOT heard) AS cls FROM bins LEFT JOIN t ON t.m = bins.m AND bins.bin BETWEEN t.a AND t.b GROUP BY ALL)
SELECT m AS media_id, bin::int AS bin, CASE WHEN heard AND cls = 'music' THEN 'music' WHEN heard THEN 'speech' ELSE coalesce(cls, 'silence') END AS label FROM seen""",
    "newest": "SELECT o_orderkey AS id, o_orderstatus AS topic_id, o_orderdate AS segment_time FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
}
SQL["topic_resume"] = SQL["topic_assign"]
QUERIES = {f.__name__: f for f in (speaker_assign, noise_overlap, merge_adjacent, label_runs, label_durations, loudness, speech_spans, ad_spans, segment_group, topic_assign, topic_resume, index_stats, hier_join_stats, index_skip, upsert_replace, upsert_ignore, noise_flags, storage_events, key_times, vector_cases, date_range, newest, on_day, distinct_days, noise_reset, label_bins)}
