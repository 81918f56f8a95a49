"""JSON documents and tables in object storage: reading, listing, writing, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import text as T
from plenum.functions import times
from plenum.sources import schemas


def transcripts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """A row for each *_transcript.json or *_diarized.json document below ``path``, with its file and time of change;
    ``since`` prunes by that time before anything is read."""
    reader = spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_{transcript,diarized}.json")
    if since:
        reader = reader.option("modifiedAfter", since)
    return reader.json(path).withColumns({"file": F.col("_metadata.file_path"), "changed": F.col("_metadata.file_modification_time")})


def audio(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """Audio files as binary rows; ``dates`` keeps those whose name begins with one of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp[34]").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.where(F.substring(name, 1, 10).isin(*dates)) if dates else files


def positions(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The documents' segments as rows with their position."""
    return docs.select(*keys, F.posexplode("segments").alias("position", "s")).select(*keys, "position", "s.*")


def events(lines: DataFrame, body: str = "body", default_bucket: str | None = None) -> DataFrame:
    """(bucket, key) of storage events: the first record if there is one, its key URL-decoded; else the plain fields.
    An event that names no bucket has the default one; one with neither record nor key has neither."""
    e = F.from_json(body, schemas.EVENT)
    record = F.try_element_at(e["Records"], F.lit(1))
    key = F.coalesce(F.try_url_decode(record["s3"]["object"]["key"]), e["key"])
    bucket = F.coalesce(record["s3"]["bucket"]["name"], e["bucket"], F.lit(default_bucket).cast("string"))
    return lines.withColumns({"bucket": F.when(key.isNotNull() | e["Records"].isNotNull(), bucket), "key": key})


def pending(listed: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Transcripts whose diarized document is not there yet."""
    return listed.join(done.select(F.col(key).alias("_done")), times.diarized_key(F.col(key)) == F.col("_done"), "left_anti")


def not_indexed(docs: DataFrame, media: DataFrame, key: str = "s3_transcript_key") -> DataFrame:
    return docs.join(media.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
    """``table`` with ``rows`` put in by key: they replace what is there, or with ``ignore`` give way to it. Of several
    new rows with a key the least counts."""
    old, new = table.withColumn("_p", F.lit(0 if ignore else 1)), rows.select(*table.columns).withColumn("_p", F.lit(1 if ignore else 0))
    rest = [c for c in table.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy("_p", *rest)
    return old.unionByName(new).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_p")


def dates(spark: SparkSession, first: str | None = None, last: str | None = None) -> DataFrame:
    """The days from first to last, both included; today if not given."""
    day = lambda d: F.to_date(F.lit(d)) if d else F.current_date()
    return spark.range(1).select(F.explode(F.sequence(day(first or last), day(last or first))).alias("day"))


def with_tokens(rows: DataFrame) -> DataFrame:
    """The token and trigram columns that searches read, computed once when a table is written. Texts without Hebrew
    have no expanded tokens of their own (null): searches then take the plain ones."""
    text = F.col("text")
    expanded = F.when(T.has_hebrew(text), T.tokens(T.affix_expand(text)))
    return rows.withColumns({"text_search": T.tokens(text), "text_search_expanded": expanded, "text_trigrams": T.trigrams(text)})


def deterministic_id(*parts: str | Column) -> Column:
    """An id from a natural key, so that a rerun makes the same rows."""
    return F.md5(F.concat_ws("\x1f", *parts))


def write_json(rows: DataFrame, path: str) -> None:
    """Documents as JSON, a line for each; text is not escaped. Documents that are there are replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _labelled(name: str):
    return lambda x: x["label"] == name


#: The labels that a summary counts.
LABELS = ("speech", "music", "silence", "noise")


def noise_map(spans: DataFrame, key: str = "media_id", durations: DataFrame | None = None, classifier: str = "spectral", detected_at: Column | None = None) -> DataFrame:
    """A document for each recording: noise spans, speech spans, all, when they were found, and a summary with seconds
    and percent by label. ``durations``: (key, audio_duration); a recording without one lasts until its last span."""
    span = F.struct("start", "end", "label", F.round(F.col("end") - F.col("start"), 3).alias("duration"))
    whole = spans.groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("all_segments"), F.max("end").alias("_last"))
    if durations is not None:
        whole = whole.join(durations.select(key, "audio_duration"), key, "left")
    length = F.coalesce("audio_duration", "_last") if durations is not None else F.col("_last")
    whole = whole.withColumn("_length", F.round(length, 2))
    of = lambda test: F.filter("all_segments", test)
    summary = [F.col("_length").alias("audio_duration"), F.size("all_segments").alias("total_segments"), F.lit(classifier).alias("classifier")]
    for name in LABELS:
        seconds = F.aggregate(of(_labelled(name)), F.lit(0.0), lambda s, x: s + x["duration"])
        share = F.when(F.col("_length") > 0, F.round(100 * seconds / F.col("_length"), 1)).otherwise(F.lit(0.0))
        summary += [F.size(of(_labelled(name))).alias(f"{name}_segments"), F.round(seconds, 2).alias(f"{name}_seconds"), share.alias(f"{name}_pct")]
    found = F.date_format(F.current_timestamp() if detected_at is None else detected_at, "yyyy-MM-dd'T'HH:mm:ss")
    return whole.select(key, of(lambda x: x["label"] != "speech").alias("noise_spans"), of(lambda x: x["label"] == "speech").alias("speech_spans"), "all_segments", F.struct(*summary).alias("summary"), found.alias("detected_at"))


def noise_maps(spark: SparkSession, path: str, key: str = "media_id") -> DataFrame:
    """Such documents as ``write_json`` has left them."""
    return spark.read.schema(f"{key} string, {schemas.NOISE_MAP}").json(path)


def spans_of(maps: DataFrame, key: str = "media_id") -> DataFrame:
    """The noise spans of such documents as rows (key, s, e, label, span_index)."""
    rows = maps.select(key, F.posexplode("noise_spans").alias("span_index", "x"))
    return rows.select(key, F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.label").alias("label"), "span_index")


def diarized(docs: DataFrame, assigned: DataFrame, turns: DataFrame, key: str = "media_id", model: str | None = None, device: str | None = None, zone: str = times.ZONE, created_at: Column | None = None) -> DataFrame:
    """The diarized document of each transcript: segments with speakers, speaker turns, how it was made, and absolute
    times, from rows of ``intervals.assign_speakers`` and the turns (key, s, e, speaker).

    ``docs``: key and either recording_start or s3_transcript_key, s3_audio_key, timestamp and filename, by which the
    start is found (the transcript's key first, then the audio's); without a start there are no absolute times."""
    lacking = {c: F.lit(None).cast("string") for c in ("s3_transcript_key", "s3_audio_key", "timestamp", "filename") if c not in docs.columns}
    docs = docs.withColumns(lacking) if lacking else docs
    if "recording_start" not in docs.columns:
        by = lambda k: times.recording_time(F.coalesce(k, F.lit("")), F.col("timestamp"), F.coalesce("filename", F.lit("")), zone)
        docs = docs.withColumn("recording_start", F.coalesce(by("s3_transcript_key"), by("s3_audio_key")))
    segs = assigned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment_index", "start", "end", "text", "speaker", "speaker_confidence"))).alias("segments"))
    sp = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "speaker"))).alias("speaker_segments"), F.countDistinct("speaker").alias("_speakers"), F.count("*").alias("_turns"))
    out = docs.join(segs, key, "left").join(sp, key, "left")
    base = F.col("recording_start")
    timed = lambda x: x.withField("start_datetime", times.absolute(base, x["start"])).withField("end_datetime", times.absolute(base, x["end"]))
    made = F.struct(
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(model).cast("string").alias("model"),
        F.lit(device).cast("string").alias("device"),
        "s3_transcript_key",
        "s3_audio_key",
        F.coalesce("_speakers", F.lit(0)).alias("speaker_count"),
        F.coalesce("_turns", F.lit(0)).alias("turn_count"),
        base.alias("recording_start"),
    )
    known = {
        "segments": F.transform("segments", timed),
        "speaker_segments": F.transform("speaker_segments", timed),
        "timestamp": F.coalesce(times.iso(base, zone), F.col("timestamp")),
        "timezone": F.when(base.isNotNull(), F.lit(zone)),
        "diarization": made,
    }
    return out.withColumns(known).drop("_speakers", "_turns")
