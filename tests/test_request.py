"""The request over tables, vectors apart and postings: the same results; texts are not shuffled; co-located tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum import api
from plenum.operators import search, text_index
from plenum.plans import indexes
from plenum.sources import colocated, documents, store


@pytest.fixture(scope="module")
def tables(spark):
    rng, words = np.random.default_rng(12), [f"w{i}" for i in range(12)] + ["common"]
    text = lambda k: " ".join(rng.choice(words, k))
    segs = [(i, i % 9, text(30), rng.normal(size=6).tolist(), i * 7 % 50, f"s{i % 2}", "radio", i % 13 == 0) for i in range(120)]
    sents = [(i * 10 + j, i, j, text(14), rng.normal(size=6).tolist(), f"s{i % 2}", "radio", False) for i in range(120) for j in range(3)]
    segments = spark.createDataFrame(segs, "segment_id int, topic_id int, text string, embedding_he array<double>, segment_time int, station string, media_type string, is_noise boolean")
    sentences = spark.createDataFrame(sents, "id int, segment_id int, sentence_index int, text string, embedding_he array<double>, station string, media_type string, is_noise boolean")
    return documents.with_tokens(sentences).cache(), documents.with_tokens(segments).cache()


def _apart(sentences, segments):
    texts = ("text", "text_search", "text_search_expanded", "text_trigrams")
    return api.Index(sentences.drop("embedding_he"), segments.drop("embedding_he", "topic_id"), sentences.drop(*texts), segments.drop(*texts))


@pytest.mark.parametrize("mode", ["hybrid", "keyword", "semantic"])
def test_vectors_apart_and_postings_change_nothing(spark, tables, mode):
    paths = []
    for rows, name in zip(tables, ("id", "segment_id")):
        paths.append(store.fresh(spark, "request"))
        text_index.write_tokens(rows, paths[-1], name, buckets=4, block=16)
    apart = _apart(*tables)
    postings = api.Index(apart.sentences, apart.segments, apart.sentence_vectors, apart.segment_vectors, *(text_index.read(spark, p, 4) for p in paths))
    vector = tables[1].first()["embedding_he"]
    for request in (api.Request("common w1", mode, limit=8), api.Request('"w1 w2" OR common -w3', mode, station="s1", limit=8)):
        got = [[(r.segment_id, round(r.score, 9), r.text, len(r.sentences)) for r in api.run(request, index, lambda _: vector).collect()] for index in (api.Index(*tables), apart, postings)]
        assert got[0] == got[1] == got[2] and (got[0] or request.station)


def test_the_query_is_embedded_once(tables):
    asked = []
    api.run(api.Request("common"), api.Index(*tables), lambda text: asked.append(text) or [1.0] * 6).collect()
    assert asked == ["common"]


def test_a_request_shuffles_no_texts(spark, tables):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    apart = _apart(*tables)
    out = api.run(api.Request("common w1"), apart, lambda _: [1.0] * 6)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # What is exchanged are the nested sentences of the results.
    assert plan.count("SortMergeJoin") <= 1 and plan.count("InMemoryTableScan") <= 2
    assert broadcast


def test_colocated_tables_meet_without_an_exchange(spark, data):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = indexes.enrich_colocated(spark, data)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and found.count() > 0
        # Recordings meet their segments where they lie; what is exchanged are counts by station.
        plan = indexes.media_stats_colocated(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert all(not re.search(r"media_id", line) for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_colocated_rows_are_whole(spark):
    path = store.fresh(spark, "co-located")
    rows = spark.range(1000).select((F.col("id") % 77).alias("k"), "id")
    colocated.write(rows, path, "k", ("id",), 4)
    assert colocated.read(spark, path).exceptAll(rows).count() == 0 and colocated.read(spark, path).count() == 1000
    colocated.forget(spark, path)


def test_topics_are_newest_first(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 7), (4, "a", 9)], "id int, topic_id string, segment_time int")
    assert [r.id for r in search.by_topic(rows, F.broadcast(spark.createDataFrame([("a",)], "topic_id string")), 2).collect()] == [2, 4]
