"""Indexing end to end, by batches and as a stream: what comes out, restarts, and that batches change nothing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import models
from plenum.streaming import indexer, ingest

MODEL = models.HashedVectors(np.linspace(0.5, 1.5, 256), 8)


def _fail_on(texts):
    if any("broken" in t for t in texts):
        raise RuntimeError
    return MODEL(texts)


SETTINGS = indexer.Settings("indexer-test", lambda: _fail_on, 0.4, 120, 0.7)


def _doc(i):
    rng = np.random.default_rng(i)
    words = [f"word{j}" for j in range(12)]
    segs = [{"start": 20.0 * k, "end": 20.0 * k + 20, "text": " ".join(rng.choice(words, 6)) + (" broken." if (i, k) == (1, 2) else "."), "speaker": f"S{k % 2}", "speaker_confidence": 0.5} for k in range(9)]
    return {"timestamp": None, "filename": None, "segments": segs}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for i in range(6):
        (root / f"st{i % 2}").mkdir(exist_ok=True)
        (root / f"st{i % 2}" / f"2026-03-1{i}_08-00_diarized.json").write_text(json.dumps(_doc(i)))
    return root


def _read(spark, tables):
    sentences, segments = (tables.finished(spark, n) for n in ("sentences", "segments"))
    own = {(r.media_id, r.sentence_index): (r.text, r.segment_id) for r in sentences.collect()}
    segs = {r.segment_id: r.asDict() for r in segments.drop("batch", "created").collect()}
    tops = {(r.station, r.topic): (r.members, tuple(np.round(r.centroid, 6))) for r in indexer.topics(spark, tables).collect()}
    return own, segs, tops


@pytest.fixture(scope="module")
def whole(spark, folder, tmp_path_factory):
    tables = indexer.Tables(str(tmp_path_factory.mktemp("whole")))
    docs = spark.read.schema("timestamp string, filename string, segments array<struct<start: double, end: double, text: string, speaker: string, speaker_confidence: double>>").option("multiLine", True).option("recursiveFileLookup", True).json(str(folder)).withColumn("s3_transcript_key", F.col("_metadata.file_path"))
    indexer.index_batch(docs, tables, 0, SETTINGS)
    return _read(spark, tables)


def test_what_is_written_belongs_together(whole):
    own, segs, tops = whole
    assert len({m for m, _ in own}) == 6 and not any("broken" in t for t, _ in own.values())
    for media in {m for m, _ in own}:
        mine = sorted((i, *v) for (m, i), v in own.items() if m == media)
        assert [i for i, *_ in mine] == list(range(len(mine)))
        for segment in {s for *_, s in mine}:
            members = [t for _, t, s in mine if s == segment]
            row = segs[segment]
            assert row["media_id"] == media and row["text"] == " ".join(members) and row["sentence_count"] == len(members)
            assert row["end_time"] - row["start_time"] <= 140 and row["topic_id"].startswith(row["station"] + "/")
    counts = {}
    for row in segs.values():
        counts[row["topic_id"]] = counts.get(row["topic_id"], 0) + 1
    assert {f"{s}/{t}": n for (s, t), (n, _) in tops.items()} == counts


def test_a_stream_of_batches_with_a_crash_gives_the_same(spark, folder, whole, tmp_path, monkeypatch):
    """Files arrive over two runs of the stream; one batch dies before its media are written and is run again."""
    import os
    import time

    source, tables = tmp_path / "in", indexer.Tables(str(tmp_path / "index"))
    names = sorted((p for p in folder.rglob("*.json")), key=lambda p: p.name)

    def put(files):
        for p in files:
            (source / p.parent.name).mkdir(parents=True, exist_ok=True)
            to = source / p.parent.name / p.name
            to.write_text(p.read_text())
            os.utime(to, (time.time() - 1000 + names.index(p) * 10,) * 2)

    def go():
        stream = ingest.transcript_stream(spark, str(source), per_trigger=2, max_age="36500d")
        return indexer.run(stream, tables, str(tmp_path / "check"), SETTINGS).awaitTermination(300)

    put(names[:3])
    go()
    put(names[3:])
    write = indexer.Tables.write

    def dying(self, name, rows, number):
        if name == "media" and number == 2:
            raise RuntimeError("the driver dies")
        return write(self, name, rows, number)

    monkeypatch.setattr(indexer.Tables, "write", dying)
    with pytest.raises(Exception, match="the driver dies"):
        go()
    monkeypatch.setattr(indexer.Tables, "write", write)
    go()
    go()
    own, segs, tops = _read(spark, tables)
    # Keys are paths, so ids differ; texts, times and topics do not.
    plain = lambda segs: sorted((s["station"], str(s["segment_time"]), s["segment_index"], s["text"], s["start_time"], s["topic_id"]) for s in segs.values())
    assert plain(segs) == plain(whole[1]) and tops == whole[2] and len(own) == len(whole[0])
    assert tables.read(spark, "media").groupBy("s3_transcript_key").count().where("count > 1").count() == 0
