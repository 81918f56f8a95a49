"""Arrivals as a stream: restarts, late files, storage events, pairs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from plenum.streaming import arrivals


def _put(root, key, age):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("{}")
    os.utime(path, (time.time() - age,) * 2)


def _run(stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("form", ["{}", "file://{}"])
def test_files_arrive_once_over_restarts_and_late_listings(spark, tmp_path, form):
    root = str(tmp_path / "in")
    _put(root, "st1/2026-03-19_08-00_transcript.json", 500)
    _put(root, "tv/ch/2026-03-19_09-00_diarized.json", 400)
    _put(root, "top_transcript.json", 300)
    _put(root, "st1/old_transcript.json", 9000)
    go = lambda: _run(arrivals.listed(spark, form.format(root), look_back=600, since=time.time() - 5000), tmp_path, "out")
    go()
    first = {(r.key, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert first == {("st1/2026-03-19_08-00_transcript.json", "transcript"), ("tv/ch/2026-03-19_09-00_diarized.json", "diarized"), ("top_transcript.json", "transcript")}
    _put(root, "st2/new.mp3", 1)
    _put(root, "st1/late_transcript.json", 200)  # shown only now, although it changed before the last batch
    go()
    go()
    rows = [r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {k for k, _ in first} | {"st2/new.mp3", "st1/late_transcript.json"}


def test_each_pair_once_whichever_comes_first(spark, tmp_path):
    root = str(tmp_path / "in")
    go = lambda: _run(arrivals.paired(arrivals.listed(spark, root, look_back=900), wait=3600), tmp_path, "out")
    _put(root, "s/a_transcript.json", 700)
    _put(root, "s/b_diarized.json", 690)
    _put(root, "s/c_transcript.json", 680)
    go()
    _put(root, "s/a_diarized.json", 300)
    _put(root, "s/b_transcript.json", 290)
    go()
    _put(root, "s/d_transcript.json", 200)
    _put(root, "s/d_diarized.json", 100)
    go()
    got = [(r.key, r.diarized_key) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [(f"s/{x}_transcript.json", f"s/{x}_diarized.json") for x in "abd"]


def test_a_transcript_whose_wait_is_over_comes_alone(spark, tmp_path):
    root = str(tmp_path / "in")
    go = lambda: _run(arrivals.paired(arrivals.listed(spark, root, look_back=5000), wait=60, unpaired=True), tmp_path, "out")
    _put(root, "s/a_transcript.json", 20000)
    _put(root, "s/b_transcript.json", 20010)
    _put(root, "s/b_diarized.json", 20000)
    go()
    for age in (5, 1):
        _put(root, f"s/later{age}_transcript.json", age)
        _put(root, f"s/later{age}_diarized.json", age)
        go()
    got = {(r.key, r.diarized_key) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("s/a_transcript.json", None) in got and ("s/b_transcript.json", "s/b_diarized.json") in got and ("s/b_transcript.json", None) not in got


def test_storage_events_arrive_once(spark, tmp_path):
    record = lambda key: {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": key}}}]}
    bodies = [record("s/a%20b_transcript.json"), record("s/a%20b_transcript.json"), {"key": "s/a b_diarized.json"}, {}, {"key": "x.mp3", "bucket": "c"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps({"body": json.dumps(b), "changed": f"2026-03-19 08:00:0{i}"}) for i, b in enumerate(bodies)))
    lines = spark.readStream.schema("body string, changed timestamp").json(str(tmp_path / "in"))
    _run(arrivals.from_events(lines, default_bucket="main"), tmp_path, "out")
    got = sorted((r.key, r.kind, r.bucket) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s/a b_diarized.json", "diarized", "main"), ("s/a b_transcript.json", "transcript", "b"), ("x.mp3", "other", "c")]
    pairs = arrivals.paired(arrivals.from_events(lines))
    _run(pairs, tmp_path, "pairs")
    assert [r.key for r in spark.read.parquet(str(tmp_path / "pairs")).select(F.col("key")).collect()] == ["s/a b_transcript.json"]
