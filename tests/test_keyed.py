"""Tables updated by key: only the buckets of a change are written, readers see one version, two writers don't mix."""

import os

import pytest
from pyspark.sql import functions as F

from plenum.operators import links
from plenum.sources import keyed


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 80).alias("m"), F.col("id").alias("i"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("segment_id"))
    return keyed.KeyedTable(spark, str(tmp_path / "t"), "m", buckets=16).create(rows)


def _files(table):
    out = {}
    for folder, _, names in os.walk(f"{table.path}/data"):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_update_writes_its_buckets_only(spark, table):
    before, old = _files(table), _rows(table.read())
    changes = spark.createDataFrame([(3, 83, "s1"), (3, 83, "s0"), (3, 999, "s2"), (7, 7, None)], "m long, i long, segment_id string")
    assert table.update(changes, ["m", "i"]) == 2
    new = {r.i: r.segment_id for r in table.read().collect()}
    assert new[83] == "s0" and sum(v is not None for v in new.values()) == 1 and len(new) == 400
    after = _files(table)
    assert all(after[f] == t for f, t in before.items())  # no file was changed, and few were added
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in after if f not in before}) <= 2
    assert _rows(table.read(1)) == old and table.version() == 2
    assert table.vacuum() in (1, 2) and len(_files(table)) == len(before)
    assert {r.i: r.segment_id for r in table.read().collect()} == new


def test_upsert_replace_and_reads_by_key(spark, table):
    rows = spark.createDataFrame([(5, 5, "new", "a"), (500, 1000, "more", None)], table.read().schema)
    table.upsert(rows, ["m", "i"])
    assert {(r.m, r.i, r.text) for r in table.read().where("text NOT LIKE 't%'").collect()} == {(5, 5, "new"), (500, 1000, "more")}
    table.upsert(rows.withColumn("text", F.lit("later")), ["m", "i"], ignore=True)
    assert table.read().where("text = 'later'").count() == 0 and table.read().count() == 401
    keys = spark.createDataFrame([(5,), (600,)], "m long")
    assert table.of(keys).count() == 5
    table.replace(rows.limit(0), keys)
    assert table.read().count() == 396 and table.of(keys).count() == 0
    assert table.update(rows.limit(0).select("m", "i", "segment_id"), ["m", "i"]) == table.version()


def test_two_writers_and_a_dead_one(spark, table):
    version, rows = table.version(), _rows(table.read())
    table._put(spark.createDataFrame([(1, 1, "lost", None)], table.read().schema))  # files without a manifest
    assert _rows(table.read()) == rows
    with pytest.raises(keyed.Conflict):
        table._publish(version, table._manifest())
    assert table.vacuum() == 1 and _rows(table.read()) == rows
    with pytest.raises(FileNotFoundError):
        keyed.KeyedTable(spark, table.path + "-none", "m").read()


def test_noise_flags_are_written_back_and_cleared(spark, tmp_path):
    kinds = "media_id int, sentence_index int, segment_id string, is_noise boolean, noise_type string"
    sentences = keyed.KeyedTable(spark, str(tmp_path / "s"), "media_id").create(spark.createDataFrame([(1, 0, "a", True, "old"), (1, 1, "a", None, None), (1, 2, "b", True, "old"), (1, 3, None, None, None), (2, 0, "c", True, "old")], kinds))
    segments = keyed.KeyedTable(spark, str(tmp_path / "g"), "media_id").create(spark.createDataFrame([(1, "a", True, "old"), (1, "b", None, None), (2, "c", True, "old")], "media_id int, segment_id string, is_noise boolean, noise_type string"))
    found = spark.createDataFrame([(1, 0, "jingle"), (1, 1, "commercial")], "media_id int, sentence_index int, noise_type string")
    links.write_noise(sentences, segments, found)
    assert _rows(sentences.read()) == _rows(spark.createDataFrame([(1, 0, "a", True, "jingle"), (1, 1, "a", True, "commercial"), (1, 2, "b", False, None), (1, 3, None, False, None), (2, 0, "c", True, "old")], kinds))
    assert {(r.segment_id, r.is_noise, r.noise_type) for r in segments.read().collect()} == {("a", True, "commercial"), ("b", False, None), ("c", True, "old")}
    links.clear_noise(sentences, segments, spark.createDataFrame([(1,)], "media_id int"))
    assert {(r.segment_id, r.is_noise, r.noise_type) for r in segments.read().collect()} == {("a", False, None), ("b", False, None), ("c", True, "old")}
    assert {r.is_noise for r in sentences.read().where("media_id = 1").collect()} == {False} and sentences.read().count() == 5
