import json

from plenum import api
from plenum.functions import constants as C
from plenum.operators import intervals
from plenum.sources import documents
from plenum.streaming import ingest
from pyspark.sql import functions as F


def _write(folder, name, texts):
    folder.mkdir(parents=True, exist_ok=True)
    segs = [{"start": 10.0 * i, "end": 10.0 * i + 10, "text": t, "speaker": s, "speaker_confidence": 0.9} for i, (t, s) in enumerate(texts)]
    (folder / name).write_text(json.dumps({"timestamp": "2026-03-18T21:30:00", "segments": segs}, ensure_ascii=False))


def test_stream_indexes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    _write(src / "st1", "2026-03-19_08-00_diarized.json", [("First sentence here. Second one.", "A"), (C.INDEX_AD_STARTS[0], "A"), ("Something sold.", "B"), (C.INDEX_AD_ENDS[0] + ".", "A"), ("Last words.", "A")])
    paths = [str(tmp_path / x) for x in ("media", "sentences", "check")]
    go = lambda: ingest.run(ingest.transcript_stream(spark, str(src), max_age="36500d"), *paths).awaitTermination(120)
    assert go()
    rows = spark.read.parquet(paths[1]).orderBy("sentence_index").collect()
    assert [r.text for r in rows] == ["First sentence here.", "Second one.", "Last words."]
    _write(src / "tv/ch", "2026-03-19_09-00_diarized.json", [("Hello there again.", "A")])
    assert go()
    media = spark.read.parquet(paths[0]).orderBy("station").collect()
    assert [(m.station, m.media_type) for m in media] == [("st1", "radio"), ("tv/ch", "tv")]
    assert spark.read.parquet(paths[1]).count() == len(rows) + 1


def test_listing_pending_and_noise_map(spark, tmp_path):
    _write(tmp_path / "s", "a_transcript.json", [("x y z", None)])
    docs = documents.transcripts(spark, str(tmp_path), "2020-01-01T00:00:00")
    assert docs.count() == 1 and documents.transcripts(spark, str(tmp_path), "2099-01-01T00:00:00").count() == 0
    listed = spark.createDataFrame([("s/a_transcript.json",), ("s/b_transcript.json",)], "key string")
    done = spark.createDataFrame([("s/a_diarized.json",)], "key string")
    assert [r.key for r in documents.pending(listed, done).collect()] == ["s/b_transcript.json"]
    spans = spark.createDataFrame([("m", 0.0, 2.0, "speech"), ("m", 2.0, 5.0, "music")], "media_id string, start double, end double, label string")
    row = documents.noise_map(spans).first()
    assert (len(row.noise_spans), len(row.speech_spans), row.summary.music_seconds, row.summary.total_segments) == (1, 1, 3.0, 2)
    assert [r.label for r in documents.spans_of(documents.noise_map(spans)).collect()] == ["music"]


def test_diarized_document(spark):
    segs = spark.createDataFrame([("m", 0, 0.0, 2.0, "hi")], "media_id string, segment_index int, start double, end double, text string")
    turns = spark.createDataFrame([("m", 0.0, 2.0, "A")], "media_id string, s double, e double, speaker string")
    docs = spark.createDataFrame([("m", "2026-03-18 21:30:00")], "media_id string, r string").select("media_id", F.col("r").cast("timestamp").alias("recording_start"))
    row = documents.diarized(docs, intervals.assign_speakers(segs, turns), turns).first()
    assert row.segments[0].speaker == "A" and row.diarization.speaker_count == 1 and str(row.segments[0].end_datetime) == "2026-03-18 21:30:02"


def test_search_modes(spark):
    segs = spark.createDataFrame([(str(i), "t1", f"word{i} common text of some length here and more to say", [1.0, i / 10], None, i) for i in range(5)], "segment_id string, topic_id string, text string, embedding_he array<double>, is_noise boolean, segment_time int").withColumns({"station": F.lit("s"), "media_type": F.lit("radio")})
    index = api.Index(segs.withColumn("id", F.col("segment_id")), segs)
    for mode in ("hybrid", "semantic", "keyword"):
        got = api.run(api.Request("common -word3", mode, limit=3), index, lambda text: [1.0, 0.0]).collect()
        assert got and all("word3" not in r.text for r in got) and len(got) <= 3


def test_audio_files_of_some_days(spark, tmp_path):
    for name in ("st/2026-03-19_08-00.mp3", "st/2026-03-20_08-00.mp3", "tv/ch/2026-03-19_09-00.mp4", "st/2026-03-19_08-00.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = documents.audio(spark, str(tmp_path), ["2026-03-19"])
    assert sorted(bytes(r.content).decode() for r in files.collect()) == ["st/2026-03-19_08-00.mp3", "tv/ch/2026-03-19_09-00.mp4"]
    assert documents.audio(spark, str(tmp_path)).count() == 3


def test_noise_maps_and_diarized_documents_have_all_fields(spark, tmp_path):
    spans = spark.createDataFrame([("m", 0.0, 2.0, "speech"), ("m", 2.0, 5.0, "music"), ("n", 0.0, 1.0, "speech")], "media_id string, start double, end double, label string")
    lengths = spark.createDataFrame([("m", 10.0)], "media_id string, audio_duration double")
    documents.write_json(documents.noise_map(spans, durations=lengths, classifier="ina"), str(tmp_path / "maps"))
    got = {r.media_id: r for r in documents.noise_maps(spark, str(tmp_path / "maps")).collect()}
    m, n = got["m"], got["n"]
    assert (m.summary.audio_duration, m.summary.music_pct, m.summary.speech_pct, m.summary.classifier) == (10.0, 30.0, 20.0, "ina") and m.detected_at
    assert (n.summary.audio_duration, n.summary.speech_pct, n.summary.noise_pct, n.noise_spans) == (1.0, 100.0, 0.0, [])
    segs = spark.createDataFrame([("m", 0, 0.0, 2.0, "hi")], "media_id string, segment_index int, start double, end double, text string")
    turns = spark.createDataFrame([("m", 0.0, 2.0, "A")], "media_id string, s double, e double, speaker string")
    docs = spark.createDataFrame([("m", "st/none_transcript.json", "st/2026-07-01_08-00.mp3", None, None), ("x", "y", "z", None, None)], "media_id string, s3_transcript_key string, s3_audio_key string, timestamp string, filename string")
    found = {r.media_id: r for r in documents.diarized(docs, intervals.assign_speakers(segs, turns), turns, model="m1", device="cpu").collect()}
    m, x = found["m"], found["x"]
    assert (m.timestamp, m.timezone, str(m.segments[0].start_datetime)) == ("2026-07-01T08:00:00+03:00", "Asia/Jerusalem", "2026-07-01 05:00:00")
    assert (m.diarization.model, m.diarization.device, m.diarization.s3_audio_key, m.diarization.turn_count) == ("m1", "cpu", "st/2026-07-01_08-00.mp3", 1) and m.diarization.created_at
    assert x.timestamp is None and x.timezone is None and x.diarization.speaker_count == 0
