"""Topics that go on where an earlier run, batch or process has ended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.operators import indexing
from plenum.streaming import topics as streaming


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 6))
    made = [(i, ("a", "b", "c")[int(rng.integers(0, 3))] if i % 10 else "a", (centres[int(rng.integers(0, 25))] + 0.3 * rng.normal(size=6)).tolist() if i % 17 else None) for i in range(600)]
    return spark.createDataFrame(made, "id long, station string, embedding_he array<double>").cache()


@pytest.fixture(scope="module")
def whole(rows):
    return {(r.station, r.id): (r.topic, r.members, tuple(np.round(r.centroid, 9))) for r in indexing.topics(rows, "station", ["id"], states=True).collect()}


def test_topics_by_restatement(rows, whole):
    known = {}
    for r in rows.where("embedding_he IS NOT NULL").orderBy("id").collect():
        own, v = known.setdefault(r.station, []), np.array(r.embedding_he)
        near = [c @ v / np.linalg.norm(c) / np.linalg.norm(v) for c, _ in own]
        at = int(np.argmax(near)) if near and max(near) >= 0.8 else len(own)
        if at == len(own):
            own.append((v, 1))
        else:
            c, n = own[at]
            own[at] = ((c * n + v) / (n + 1), n + 1)
        assert whole[r.station, r.id][:2] == (at, own[at][1])
    assert len(whole) == rows.where("embedding_he IS NOT NULL").count() and max(t for t, _, _ in whole.values()) > 16


def test_a_second_run_goes_on_from_the_table_of_the_first(rows, whole):
    first = indexing.topics(rows.where("id < 250"), "station", ["id"], states=True).cache()
    table = indexing.topic_table(first, "station")
    second = indexing.topics(rows.where("id >= 250"), "station", ["id"], known=table, states=True).cache()
    got = {(r.station, r.id): (r.topic, r.members, tuple(np.round(r.centroid, 9))) for r in first.unionByName(second).collect()}
    assert got == whole
    last = {}
    for (station, _), (topic, members, centroid) in sorted(whole.items()):
        last[station, topic] = (members, centroid)
    both = indexing.topic_table(second, "station", table).collect()
    assert {(r.station, r.topic): (r.members, tuple(np.round(r.centroid, 9))) for r in both} == last


def test_a_stream_keeps_topics_over_batches_and_restarts(spark, rows, whole, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    name, value = streaming.PROVIDER
    spark.conf.set(name, value)
    try:

        def run():
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = streaming.assigned(stream, "station", ["id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination()

        # Two batches in the first run, and one more in a query that starts again from the checkpoint.
        for part in (rows.where("id < 100"), rows.where("id >= 100 AND id < 300")):
            part.coalesce(1).write.mode("append").parquet(source)
        run()
        rows.where("id >= 300").coalesce(1).write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.unset(name)
    found = spark.read.parquet(out)
    assert {(r.station, r.id): (r.topic, r.members, tuple(np.round(r.centroid, 9))) for r in found.collect()} == whole
    assert indexing.topic_table(found, "station").agg(F.sum("members")).first()[0] == len(whole)
